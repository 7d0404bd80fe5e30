"""Array and map expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid.functions.numeric import round_exact
from vitalgrid.functions.text import fold


def literals(values: Sequence) -> Column:
    return F.array(*[F.lit(value) for value in values])


def present(*items: Column) -> Column:
    """Array of the non-NULL items, in order. The items must differ from each other."""
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def nth(values: Column, position: Column) -> Column:
    """Item at a 1-based position, NULL for a NULL position or one outside.

    ``element_at`` would do, but its generated code overlooks a NULL position when the
    array is a constant, and then answers with the last item.
    """
    return F.get(values, position - 1)


def lookup(code: Column, table: dict, default: Column | None = None) -> Column:
    """Constant for a code of a small fixed table, as one CASE expression."""
    if not table:
        return default if default is not None else F.lit(None)
    pairs = list(table.items())
    chain = reduce(lambda acc, kv: acc.when(code == kv[0], F.lit(kv[1])), pairs[1:], F.when(code == pairs[0][0], F.lit(pairs[0][1])))
    return chain.otherwise(default) if default is not None else chain


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column used inside a lambda may be inlined there by the optimizer and computed anew
    for every item. A one-item array carries it in as a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of doubles, shifted by its maximum."""

    def shares(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(weights, lambda w: w / t))

    def weights_of(z: Column) -> Column:
        return bind(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))

    return bind(logits, lambda z: bind(weights_of(z), shares))


def first_greatest(values: Column) -> Column:
    """1-based position of the greatest item; the first one wins ties."""
    return F.array_position(values, F.array_max(values)).cast("int")


def rounded(values: Column, digits: int) -> Column:
    return F.transform(values, lambda x: round_exact(x, digits))


def labelled(labels: Sequence[str], values: Column) -> Column:
    return F.map_from_arrays(literals(labels), values)


def mean_and_spread(values: Column) -> Column:
    """Struct of mean and population deviation, in one pass (Welford's update)."""

    def include(acc: Column, x: Column) -> Column:
        n, step = acc["n"] + 1.0, x - acc["mean"]
        mean = acc["mean"] + step / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + step * (x - mean)).alias("squares"))

    def finish(acc: Column) -> Column:
        return F.struct(
            F.when(acc["n"] > 0, acc["mean"]).alias("mean"),
            F.sqrt(F.try_divide(acc["squares"], acc["n"])).alias("spread"),
        )

    start = F.struct(*[F.lit(0.0).alias(name) for name in ("n", "mean", "squares")])
    return F.aggregate(values, start, include, finish)


def symptom_set(symptoms: Column) -> Column:
    """Folded distinct symptoms for the additive rules.

    Empty texts are dropped first; a text of blanks survives as one empty symptom.
    """
    kept = F.filter(symptoms, lambda s: s != "")
    return F.array_distinct(F.transform(kept, fold))


def symptom_set_strict(symptoms: Column) -> Column:
    """Folded distinct symptoms for the model: blank texts do not count at all."""
    return F.array_distinct(F.filter(F.transform(symptoms, fold), lambda s: s != ""))


def catalogued(symptoms: Column, catalogue: Sequence[str]) -> Column:
    """Symptoms of the catalogue, order and repeats preserved."""
    return F.filter(symptoms, lambda s: s.isin(*catalogue))


def text_items(values: Column) -> Column:
    """Items as texts; an empty array for NULL."""
    return F.coalesce(F.transform(values, lambda v: v.cast("string")), F.array().cast("array<string>"))
