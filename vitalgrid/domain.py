"""Fixed values of the clinical domain: labels, catalogues, thresholds, messages.

Everything here is plain data that results have to agree on. Logic lives in
``functions`` and ``operators``.
"""

from __future__ import annotations

# --- fixed values: study batches -------------------------------------------------

REQUIRED_COLUMNS = (
    "study_id",
    "patient_age",
    "patient_sex",
    "image_object_key",
    "label",
    "acquisition_date",
    "source",
)
OBJECT_KEY = "image_object_key"
VALID_LABELS = ("Sana", "Neumonia", "COVID-19")
REJECTED_SAMPLE_ROWS = 25

REASON_INCOMPLETE = "incomplete"
REASON_LABEL = "invalid_label"
REASON_DUPLICATE = "duplicate"

STATUS_COMPLETED = "completed"
STATUS_WARNINGS = "completed_with_warnings"
STATUS_FAILED = "failed"

# --- fixed values: triage --------------------------------------------------------

RISK_LABELS = ("low", "medium", "high", "critical")
PRIORITY_BY_RISK = {
    "low": "standard",
    "medium": "priority",
    "high": "urgent",
    "critical": "immediate",
}
DEFAULT_PRIORITY = "standard"

SYMPTOMS = (
    "chest pain",
    "shortness of breath",
    "loss of consciousness",
    "fever",
    "cough",
    "abdominal pain",
    "headache",
    "dizziness",
    "vomiting",
    "bleeding",
)
RULE_RED_FLAGS = ("chest pain", "shortness of breath", "loss of consciousness")
LABEL_RED_FLAGS = ("chest pain", "shortness of breath", "loss of consciousness", "bleeding")

VITALS = (
    "age",
    "heart_rate",
    "oxygen_saturation",
    "systolic_bp",
    "respiratory_rate",
    "temperature",
)
# form default, lowest and highest accepted value
VITAL_RANGES = {
    "age": (45.0, 0, 120),
    "heart_rate": (80.0, 20, 220),
    "oxygen_saturation": (98.0, 50, 100),
    "systolic_bp": (120.0, 40, 260),
    "respiratory_rate": (16.0, 4, 60),
    "temperature": (36.8, 30, 43),
}
MODEL_DEFAULTS = {name: bounds[0] for name, bounds in VITAL_RANGES.items()}
RULE_DEFAULTS = {"heart_rate": 0.0, "oxygen_saturation": 100.0, "systolic_bp": 120.0}
FEATURES = VITALS + tuple(f"symptom__{name}" for name in SYMPTOMS)

# additive rules: points per symptom up to a cap, then one bonus per condition
POINTS_PER_SYMPTOM, SYMPTOM_POINTS_CAP, SCORE_CAP = 8, 40, 100
RED_FLAG_POINTS = 35
HEART_RATE_AT_LEAST, HEART_RATE_POINTS = 120, 15
OXYGEN_BELOW, OXYGEN_POINTS = 92, 25
PRESSURE_BELOW, PRESSURE_POINTS = 90, 20
# lowest score of each risk level, highest level first
RISK_FROM_SCORE = ((75, "critical"), (50, "high"), (25, "medium"), (0, "low"))
CONFIDENCE_CEILING, CONFIDENCE_BASE, CONFIDENCE_DIVISOR = 0.99, 0.65, 200

# early-warning bands: points for values up to / from a limit, nearest extreme first
EARLY_WARNING_BANDS = {
    "respiratory_rate": {"up_to": ((8, 3), (11, 1)), "from": ((25, 3), (21, 2))},
    "oxygen_saturation": {"up_to": ((91, 3), (93, 2), (95, 1)), "from": ()},
    "systolic_bp": {"up_to": ((90, 3), (100, 2), (110, 1)), "from": ((220, 3),)},
    "heart_rate": {"up_to": ((40, 3), (50, 1)), "from": ((131, 3), (111, 2), (91, 1))},
    "temperature": {"up_to": ((35.0, 3), (36.0, 1)), "from": ((39.1, 2), (38.1, 1))},
}
SEVERITY_AGE, SEVERITY_AGE_POINTS, SEVERITY_RED_FLAG_POINTS = 75, 1, 2
SEVERITY_LEVELS = ((9, "critical"), (6, "high"), (3, "medium"))
CRITICAL_RED_FLAGS, CRITICAL_OXYGEN = 2, 88

LOW_CONFIDENCE = 0.55
RULES_MODEL_NAME = "hospital-triage-rules-fallback"
FOREST_MODEL_NAME = "hospital-triage-rf-calibrated"
FOREST_MODEL_VERSION = "1.0.0"
FOREST_MODEL_FAMILY = "random_forest_isotonic_calibration"
SYNTHETIC_BASIS = "MEWS/NEWS2-inspired rules with label noise"
CLINICAL_READING_HINT = (
    "Atender especialmente al recall de la clase 'critical' y a los falsos negativos de SpO2 baja o sintomas red-flag."
)
TRIAGE_NOTE = (
    "Salida del modelo de triaje. Apoyo a la decision clinica; "
    "no sustituye la valoracion del personal sanitario."
)
ALERT_CRITICAL = "Activar codigo de atencion inmediata."
ALERT_TRIAGE_CONFIDENCE = "Confianza baja: validar con personal sanitario."
ALERT_CHEST_PAIN = "Dolor toracico con riesgo elevado: priorizar ECG."

NAME_REQUIRED = "El nombre del paciente es obligatorio."
NAME_MAX_LENGTH = 200
NOT_NUMERIC = "El campo '%s' debe ser numerico."
OUT_OF_RANGE = "El campo '%s' debe estar entre %s y %s."

# --- fixed values: radiology -----------------------------------------------------

MODEL_CLASSES = ("COVID-19", "Sana", "Neumonia")
DISPLAY_CLASSES = ("Sana", "Neumonia", "COVID-19")
CRITICAL_CLASS = "COVID-19"
FOLDER_LABELS = {"COVID19": "COVID-19", "NORMAL": "Sana", "PNEUMONIA": "Neumonia"}

DARK_BELOW, BRIGHT_ABOVE, FLAT_BELOW = 45, 230, 18
FLAG_DARK = "Imagen muy oscura: revisar exposicion o contraste antes de decidir."
FLAG_BRIGHT = "Imagen muy clara: puede perder detalles pulmonares relevantes."
FLAG_FLAT = "Contraste bajo: el estudio puede ser dificil de interpretar."
FLAG_CONFIDENCE = "Prediccion con baja confianza: requiere revision medica prioritaria."

STUDY_ALERT_CONTAGION = "Priorizar revision medica y activar protocolo de enfermedad contagiosa."
STUDY_ALERT_CONFIDENCE = "Enviar a cola de revision por baja confianza del modelo."
STUDY_ALERT_QUALITY = "Repetir o validar estudio por posibles problemas de calidad."

EVENT_COVID = "Radiografia clasificada como COVID-19: requiere revision prioritaria."
EVENT_CONFIDENCE = "Prediccion radiologica con baja confianza."
EVENT_IMAGE = "Estudio radiologico con advertencias de calidad."
EVENT_REJECTIONS = (
    "El pipeline rechazo registros por campos incompletos, etiquetas invalidas o duplicados."
)
EVENT_RUN_FAILED = "El pipeline de datos fallo durante la ejecucion."
EVENT_TRIAGE_CRITICAL = "Triaje clasificado como critical: requiere atencion inmediata."

EXPLANATIONS = {
    "Sana": (
        "La distribucion de intensidad se aproxima al patron basal definido para estudios "
        "sin hallazgos dominantes."
    ),
    "Neumonia": (
        "La imagen concentra rasgos de intensidad y contraste compatibles con infiltrados, "
        "por lo que debe revisarse clinicamente."
    ),
    "COVID-19": (
        "La lectura muestra un patron que el sistema marca para descarte de COVID-19 y "
        "seguimiento epidemiologico."
    ),
}
RADIOLOGY_NOTE = (
    "Resultado de apoyo: no sustituye la valoracion del personal sanitario ni "
    "debe utilizarse como diagnostico autonomo."
)

MAX_IMAGE_BYTES = 5 * 1024 * 1024
IMAGE_FORMATS = {"JPEG": ("jpg", "jpeg"), "PNG": ("png",)}
# leading bytes as hexadecimal digits, "?" for any
IMAGE_MAGIC = {
    "PNG": "89504E470D0A1A0A",
    "JPEG": "FFD8FF",
    "GIF": "474946383761",
    "GIF89A": "474946383961",
    "BMP": "424D????????00000000",
    "TIFF": "49492A00",
    "TIFF_MM": "4D4D002A",
    "WEBP": "52494646????????57454250",
}
IMAGE_MIME_TYPES = ("image/jpeg", "image/png")
IMAGE_NAME_MISSING = "A file is required"
IMAGE_TYPE_UNSUPPORTED = "Unsupported file type"
IMAGE_EMPTY = "Empty file"
IMAGE_TOO_LARGE = "File exceeds the size limit"
IMAGE_UNREADABLE = "Invalid image file"
IMAGE_FORMAT_UNSUPPORTED = "Unsupported image format"
IMAGE_MISMATCH = "File extension does not match the image content"
# the upload form checks the same things and answers in its own words
UPLOAD_NAME_INVALID = "El nombre del archivo no es valido."
UPLOAD_NO_EXTENSION = "El archivo debe tener extension."
UPLOAD_FORMAT = "Formato no permitido. Use JPG, JPEG o PNG."
UPLOAD_EMPTY = "El archivo esta vacio."
UPLOAD_TOO_LARGE = "El archivo supera el tamano maximo de 5 MB."
UPLOAD_UNREADABLE = "El archivo no es una imagen valida."
UPLOAD_MISMATCH = "La extension no coincide con el contenido de la imagen."

# --- fixed values: display texts -------------------------------------------------

RISK_DISPLAY = {"low": "Bajo", "medium": "Medio", "high": "Alto", "critical": "Critico"}
PRIORITY_DISPLAY = {
    "standard": "Estandar",
    "priority": "Prioritario",
    "urgent": "Urgente",
    "immediate": "Inmediato",
}
RISK_MISSING, PRIORITY_MISSING = "Sin clase", "-"
CLASS_TONES = {"Sana": "healthy", "Neumonia": "pneumonia", "COVID-19": "covid"}
# class: (state, title, icon, description, eyebrow)
CLASS_RESULTS = {
    "Sana": (
        "healthy",
        "Sana",
        "verified",
        "No se observan hallazgos dominantes compatibles con neumonia o COVID-19. "
        "La revision medica debe confirmar la interpretacion clinica final.",
        "Resultado detectado",
    ),
    "Neumonia": (
        "pneumonia",
        "Neumonia",
        "warning",
        "Se observan patrones compatibles con infiltrados pulmonares. "
        "Se recomienda correlacion clinica inmediata por parte del especialista.",
        "Resultado detectado",
    ),
    "COVID-19": (
        "covid",
        "COVID-19",
        "coronavirus",
        "La imagen presenta rasgos que requieren descarte clinico dirigido de COVID-19. "
        "La valoracion definitiva debe integrarse con sintomas y pruebas complementarias.",
        "Resultado detectado",
    ),
}
CLASS_PENDING = (
    "pending",
    "Esperando analisis",
    "pending",
    "Cargue una radiografia valida para generar la clasificacion asistida y "
    "las probabilidades del estudio.",
    "Estado del diagnostico",
)
BACKEND_UNAVAILABLE = "no disponible"

# what a snapshot shows where it has nothing
DEFAULT_SECTIONS = {
    "radiology": {
        "total_studies": 0,
        "class_distribution": {"Sana": 0, "Neumonia": 0, "COVID-19": 0},
        "warning_count": 0,
        "average_confidence": 0.0,
        "last_study_at": None,
    },
    "triage": {"total_records": 0},
    "pipeline": {"latest_run": None},
    "quality": {"open_events_by_severity": {}},
    "triage_model": {"loaded": False, "model_name": None},
    "recent_studies": [],
    "quality_events": [],
    "recent_triages": [],
    "backend_status": BACKEND_UNAVAILABLE,
}
