"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a form or symptom text is stripped of (all Unicode
# white space plus the four ASCII separators). Study batches only lose spaces.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Without white space at both ends; texts that clearly have none pass at once."""
    tight = text.rlike(r"^[!-~](?:[ -~]*[!-~])?$")
    return F.when(tight, text).otherwise(F.trim(text, F.lit(WHITE_SPACE)))


def fold(text: Column) -> Column:
    """Stripped and lower-cased, the form symptoms are compared in."""
    return F.lower(strip(text))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def file_suffix(name: Column) -> Column:
    """Lower-case ``.ext`` of the last path part; leading dots do not start a suffix."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]*)$", 1))


def last_extension(name: Column) -> Column:
    """Lower-case text after the last dot, NULL without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def upload_key(record_id: Column, filename: Column) -> Column:
    suffix = file_suffix(filename)
    return F.concat(F.lit("uploads/"), record_id, F.when(suffix == "", ".jpg").otherwise(suffix))


def report_key(kind: str, record_id: Column) -> Column:
    """``kind`` is radiology, triage or pipeline."""
    return F.concat(F.lit(f"{kind}-reports/"), record_id, F.lit(".json"))


def patient_code(uuid_text: Column) -> Column:
    return F.concat(F.lit("PAC-"), F.upper(F.substring(uuid_text, 1, 8)))


def symptom_feature(feature: Column) -> Column:
    """Symptom named by a ``symptom__`` feature, NULL for any other feature."""
    return F.when(feature.startswith("symptom__"), F.substr(feature, F.lit(len("symptom__") + 1)))
