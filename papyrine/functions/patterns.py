"""The word lists, patterns and constants that results depend on, in their natural order.

Patterns are written once, in the syntax that Java and Python share, and used case-insensitively with
Unicode classes. Five families of identifier patterns exist; they are not interchangeable.
"""
from __future__ import annotations

# --- fixed values: HTML traces -------------------------------------------------------------------
HTML_SHORT = ["<p", "<div", "<br", "<span", "<table", "<html", "&nbsp;", "</"]
HTML_LONG = ["<html", "<body", "<p", "<div", "<br", "<span", "<table", "<tr", "<td", "<strong", "<b", "&nbsp;", "&amp;", "</"]

# --- fixed values: OCR state ---------------------------------------------------------------------
DOWNLOAD_ERROR = "Error al descargar el archivo desde el bucket"
SHORT_TEXT = 50

# --- fixed values: legal vocabulary --------------------------------------------------------------
LEGAL_TERMS = [
    "embargo", "embargado", "expediente", "expte", "autos", "caratula", "carátula",
    "juzgado", "secretaria", "secretaría", "demandado", "demandante", "banco",
    "transferencia", "cuenta", "cbu", "cvu", "cuil", "cuit", "dni", "monto",
    "pesos", "sentencia", "medida cautelar", "oficio", "tribunal", "juez", "jueza",
    "depositar", "depósito", "orden", "judicial", "mandamiento",
]
EMBARGO_KEYWORDS = ["embargo", "embargar", "autos", "juzgado", "caratula", "carátula", "transferencia", "banco", "cuenta", "cbu", "cvu", "oficio"]

# --- fixed values: family 1, quality (ten kinds of important data) -------------------------------
IMPORTANT = {
    "dni": r"\b(?:DNI|D\.N\.I\.?|Documento)\s*[:\-]?\s*\d{6,9}\b|\b\d{7,8}\b",
    "cuil_cuit": r"\b(?:CUIL|CUIT|C\.U\.I\.L\.?|C\.U\.I\.T\.?)\s*[:\-]?\s*\d{2}[\s\-.]?\d{7,8}[\s\-.]?\d\b|\b\d{2}[\-\s]?\d{8}[\-\s]?\d\b",
    "cbu_cvu": r"\b(?:CBU|CVU)\s*[:\-]?\s*\d(?:[\s\-.]?\d){15,25}\b",
    "expediente": r"\b(?:expediente|expte|autos|causa)\b.{0,40}\d",
    "monto": r"(?:\$|pesos|ARS|USD)\s*[\d\.]+(?:,\d{2})?|\b\d{1,3}(?:\.\d{3})+(?:,\d{2})?\b",
    "fecha": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{1,2}\s+de\s+[a-záéíóúñ]+\s+de\s+\d{4}\b",
    "alias": r"\balias\b\s*[:\-]?\s*[a-z0-9áéíóúñ]+(?:[\.\-][a-z0-9áéíóúñ]+){1,4}",
    "banco": r"\b(?:banco|bancaria|bancario|macro|nacion|nación|galicia|santander|bbva|supervielle|credicoop|brubank|mercado\s*pago)\b",
    "caratula": r"\b(?:caratula|carátula|autos)\b",
    "juzgado_secretaria": r"\b(?:juzgado|secretaria|secretaría|tribunal|camara|cámara)\b",
}

# --- fixed values: family 2, selection -----------------------------------------------------------
SELECTION = {
    "tiene_dni_regex": r"\b(?:dni|documento|d\.?n\.?i\.?)\s*(?:n(?:ro|°|º)?\.?)?\s*:?\s*\d{1,2}(?:\.?\d{3}){2}\b",
    "tiene_cuil_cuit_regex": r"\b(?:cuil|cuit|c\.?u\.?i\.?[lt]\.?)\s*:?\s*\d{2}[-\s]?\d{8}[-\s]?\d\b|\b\d{2}-\d{8}-\d\b",
    "tiene_cbu_cvu_regex": r"\b(?:cbu|cvu)\s*:?\s*\d(?:[\s-]?\d){21}\b",
    "tiene_monto_regex": r"(?:\$|ars|pesos?)\s*\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?|\b\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?\s*(?:pesos|ars)\b",
    "tiene_expediente_regex": r"\b(?:expte|expediente|autos)\s*(?:n(?:ro|°|º)?\.?)?\s*:?\s*[A-Z0-9./\- ]{4,}\b",
}
MASKS = [
    (r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{2}-\d{8}-\d\b", "[CUIT/CUIL]"),
    (r"\b(?:\d[\s-]?){22}\b", "[CBU/CVU]"),
    (r"\b\d{1,2}(?:\.?\d{3}){2}\b", "[DNI]"),
    (r"\$\s*\d[\d.,]*", "[MONTO]"),
]

# --- fixed values: family 3, audit flags and label families --------------------------------------
AUDIT = {
    "dni": r"\b(?:DNI|D\.N\.I\.|DOCUMENTO|DOC\.?)\D{0,20}\d{7,8}\b|\b\d{7,8}\b",
    "cuil_cuit": r"\b(?:CUIL|CUIT|C\.U\.I\.L\.|C\.U\.I\.T\.)\D{0,20}(?:20|23|24|27|30|33|34)[\-\s]?\d{8}[\-\s]?\d\b|\b(?:20|23|24|27|30|33|34)[\-\s]?\d{8}[\-\s]?\d\b",
    "cbu_cvu": r"\b(?:CBU|CVU)\D{0,20}\d(?:[\s\-]?\d){21}\b|\b\d(?:[\s\-]?\d){21}\b",
    "monto": r"(?:\$|pesos|importe|monto)\s*[\d\.\,]+",
    "expediente": r"\b(?:expediente|expte|exp\.|nro\.?|n°|numero)\D{0,30}\d+[\w\-\/]*",
}
LABEL_FAMILIES = {"dni": ["dni"], "cuil_cuit": ["cuil", "cuit"], "cbu_cvu": ["cbu", "cvu", "cuenta"], "monto": ["monto"], "expediente": ["expediente"]}
SENTINELS = ["SIN_ENTIDADES", "SIN_TEXTO", "ERROR"]

# --- fixed values: family 4, simple identifiers (group 1 is the value) ----------------------------
SIMPLE_IDS = {
    "DNI": (r"\b(?:DNI|D\.N\.I\.|DOCUMENTO|DOC\.?)\s*(?:N[°º\*ro\.]*\s*)?[:\-]?\s*(\d{1,2}[\.\s]?\d{3}[\.\s]?\d{3}|\d{7,8})\b", r"\d{7,8}"),
    "CUIL": (r"\b(?:CUIL|C\.U\.I\.L\.)\s*[:\-]?\s*((?:20|23|24|27)[\-\s]?\d{8}[\-\s]?\d)\b", r"\d{11}"),
    "CUIT": (r"\b(?:CUIT|C\.U\.I\.T\.)\s*[:\-]?\s*((?:30|33|34)[\-\s]?\d{8}[\-\s]?\d)\b", r"\d{11}"),
    "CBU": (r"\bCBU\s*(?:N[°º\*ro\.]*\s*)?[:\-]?\s*((?:\d[\s\-]?){22})\b", r"\d{22}"),
    "CVU": (r"\bCVU\s*(?:N[°º\*ro\.]*\s*)?[:\-]?\s*((?:\d[\s\-]?){22})\b", r"\d{22}"),
}

# --- fixed values: family 5, rich entities (named groups) -----------------------------------------
RICH = {
    "ACCOUNT": r"\b(?P<label>CBU|CVU)\s*(?:N[°ºo]?\s*)?[:\-]?\s*(?P<value>(?:\d[\s\.\-]*){22})\b",
    "TAX_ID": r"\b(?P<label>CUIT|CUIL|C\.U\.I\.T\.|C\.U\.I\.L\.)\s*[_\-]?\s*(?:N[°ºo\*]?\s*)?[:\-]?\s*(?P<value>\d{2}[\s\.\-]?\d{5,8}[\s\.\-]?\d{1,4}[\s\.\-]?\d)\b",
    "DNI": r"\b(?P<label>DNI|D\.N\.I\.|D\.N\.L\.|DN!|DOCUMENTO|DOC\.)\s*(?:N[°ºo\*]?\s*)?[:\-]?\s*(?P<value>\d{1,2}[\.\,\s]?\d{3}[\.\,\s]?\d{3}|\d{7,8})\b",
    "ALIAS": r"\bALIAS\s*(?:CBU|CVU)?\s*[:\-]?\s*(?P<value>[A-Z0-9][A-Z0-9\.\-]{4,40})\b",
    "AMOUNT": r"(?P<prefix>\$|ARS|PESOS?)\s*(?P<value>\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?|\d+(?:,\d{1,2})?)",
    "AMOUNT_IN_WORDS": r"(pesos?\s+[A-ZÁÉÍÓÚÑ\s]+(?:CON\s+(?:\d{1,2}/100|\w+\s+CENTAVOS?))?)\s*$",
    "BANK": r"\b(Banco\s+(?:de\s+la\s+)?[A-ZÁÉÍÓÚÑa-z\s\.]+?)(?:,|\.|\-|Sucursal|a nombre|$)",
}
CONFIDENCE = {"ACCOUNT": 0.97, "TAX_ID": 0.96, "DNI": 0.94, "ALIAS": 0.85, "PERSON": 0.90}
LEAST_AMOUNT = 1000
PERSON_NAME = r"[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑa-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑa-záéíóúñ]+){1,5}"
DNI_MARK = r"(?:DNI|D\.N\.I\.|D\.N\.L\.|DN!)"
PERSON_NEAR_ID = [
    rf"\b(?:Sr\.?|Sra\.?|Señor|Señora)\s+(?P<name>{PERSON_NAME})\s*[,(\[]?\s*(?:titular\s+del\s+)?{DNI_MARK}",
    rf"(?P<name>{PERSON_NAME})\s*,?\s*titular\s+del\s+{DNI_MARK}",
    rf"(?P<name>{PERSON_NAME})\s*[\(\[]?\s*{DNI_MARK}",
]
PERSON_BAD_TOKENS = ["juez", "jueza", "secretario", "secretaria", "auxiliar", "firmado", "notificado", "certificado", "usuario conectado", "poder judicial", "mercado pago", "mercado libre"]
PERSON_BAD_CONTEXT = ["fecha de firma", "certificado correcto", "firmado por"]
CANDIDATE_BAD_TOKENS = ["http", "www", ".gov", "notificaciones", "firma", "certificado", "descargar", "texto", "datos", "cuit", "cuil", "dni", "cbu", "cvu", "expediente", "oficio"]
NAME_BAD_PATTERNS = [r"\bDNI\b", r"\bCUIL\b", r"\bCUIT\b", r"\bCBU\b", r"\bCVU\b", "http", "www", "notificacion", "notificaciones", "scba", r"mercado\s*pago", "banco", "juzgado", "tribunal"]
NAME_TITLES = r"^(Dr\.?|Dra\.?|Juez\.?|Jueza\.?|Secretario\.?|Secretaria\.?|Fdo\.?)\s+"
NAME_OFFICES = r"\s+(JUEZ|JUEZA|SECRETARIO|SECRETARIA|LETRADO|LETRADA)$"

# --- fixed values: OCR clean-up ------------------------------------------------------------------
SPACES = "              　"
DROPPED = "​‌‍﻿"
DOUBLE_QUOTES, SINGLE_QUOTES, DASHES, BULLETS = "“”„«»", "‘’‚", "–—−‐‑", "•●▪▫◦"
TERM_FIXES = [
    (r"\b[Ee][xх][pр][tг]?[eе]?\.?\b", "expediente", False),
    (r"\bexped[1il|]ente\b", "expediente", True),
    (r"\bexpediente\s*n[ro°º\.]*\b", "expediente nro.", True),
    (r"\bcar[aá]t[uú]la\b", "carátula", True),
    (r"\bcaratula\b", "carátula", True),
    (r"\bembarg[o0]\b", "embargo", True),
    (r"\bdemandant[e3]\b", "demandante", True),
    (r"\bjuzgad[o0]\b", "juzgado", True),
    (r"\bsecretar[i1í]a\b", "secretaría", True),
    (r"\baut[o0]s\b", "autos", True),
    (r"\bbanc[o0]\b", "banco", True),
    (r"\bcuent[a4]\b", "cuenta", True),
    (r"\btransferenc[i1]a\b", "transferencia", True),
    (r"\bc\s*[b8]\s*u\b", "CBU", True),
    (r"\bc\s*v\s*u\b", "CVU", True),
    (r"\bc\s*u\s*[i1]\s*l\b", "CUIL", True),
    (r"\bc\s*u\s*[i1]\s*t\b", "CUIT", True),
    (r"\bd\s*n\s*[i1]\b", "DNI", True),
    (r"\bm[o0]nt[o0]\b", "monto", True),
    (r"\bpes[o0]s\b", "pesos", True),
    (r"\bsentenc[i1]a\b", "sentencia", True),
    (r"\bmed[i1]da\s+cautelar\b", "medida cautelar", True),
]
LATIN = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
ALLOWED_SIGNS = ".,;:()[]{}¿?¡!/-_+$%&@#°ºª'\"\n\r\t "

# --- fixed values: contextual scoring of amounts --------------------------------------------------
AMOUNT_STRONG = ["hasta cubrir", "importe del crédito", "importe del credito", "capital reclamado", "se ha decretado el embargo", "decretado el embargo", "decrétase embargo", "decretase embargo", "trabar embargo"]
AMOUNT_MEDIUM = ["deberá ser depositada", "debera ser depositada", "deberá depositar", "debera depositar", "sumas embargadas", "embargo sobre"]
AMOUNT_EXTRA_BEFORE = ["con más la suma", "con mas la suma"]
AMOUNT_COSTS_AFTER = ["intereses y costas", "costas", "provisoriamente", "prima facie"]
AMOUNT_FALSE_CONTEXT = ["dni", "cuit", "cuil", "cbu", "cvu", "código de verificación", "codigo de verificacion"]
QUOTED_ORDERS = "los autos que ordenan"

# --- fixed values: contextual scoring of persons --------------------------------------------------
ROLE_IN_VALUE = ["juez", "jueza", "secretario", "secretaria", "auxiliar letrado"]
AUTHORITY_NEAR = ["juez", "jueza", "secretario", "secretaria", "auxiliar letrado", "firmado", "firmada", "notificado", "notificada", "certificado", "fecha de firma", "descargar certificado", "usuario conectado"]
ID_NEAR = ["dni", "d.n.i", "d.n.l", "cuil", "cuit"]
TITLES_NEAR = ["dr.", "dra.", "doctor", "doctora"]
DEBTOR_NEAR = [
    "parte demandada", "demandado", "demandada", "ejecutado", "ejecutada", "embargado", "embargada", "deudor", "deudora",
    "titular del dni", "titular dni", "titular del d.n.i", "titular d.n.i", "fondos que posea", "fondos que tenga",
    "cuentas que posea", "cuenta que posee", "cuentas del sr", "cuentas del señor", "cuentas de la sra", "cuentas de la señora",
    "cuenta del sr", "cuenta de la sra", "del sr.", "de la sra.", "del señor", "de la señora", "mercado pago del sr",
    "mercado pago de la sra", "pertenezca al ejecutado", "pertenezca a la ejecutada",
]
ID_TOKENS = [" dni", "dni ", "d.n.i", "d.n.l", "dn!", " cuil", "cuil ", " cuit", "cuit ", "cuil/cuit"]
ID_SHORT = ["dni", "d.n.i", "d.n.l", "dn!", "cuil", "cuit"]
EMBARGO_MEDIUM = [
    "hasta cubrir", "por la suma", "trábese embargo", "trabese embargo", "trabase embargo", "trabar embargo", "proceder a embargar",
    "decretado el embargo", "decrétase embargo", "decretase embargo", "retención directa", "retencion directa", "haberes mensuales que perciba",
]
THIRD_PARTY_NEAR = ["autorizado", "autorizada", "diligenciar", "diligenciamiento", "gerente", "responsable", "mercado libre", "mercado pago s.a", "mercadolibre", "poder judicial", "abogado", "abogada", "letrado", "letrada"]
ACCOUNT_NEAR = ["deberá ser depositada", "debera ser depositada", "deberá depositar", "debera depositar", "cuenta judicial", "banco", "sucursal", "a nombre", "orden de este juzgado"]

# --- fixed values: review ------------------------------------------------------------------------
REASONS = {
    "person": "No se detectó persona embargada",
    "person_score": "Persona embargada con bajo score contextual",
    "id": "No se detectó DNI/CUIL/CUIT asociado a la persona",
    "amount": "No se detectó monto principal",
    "account": "No se detectó cuenta de depósito",
    "amount_confidence": "Monto con baja confianza contextual",
}
SEVERE_ALERTS = ["alerta_reduccion_alta", "alerta_texto_muy_corto", "alerta_posible_perdida_datos"]
LOSS_ALERTS = [f"alerta_desaparece_{name}" for name in IMPORTANT]
MANUAL_COLUMNS = [
    "id", "clasificacion", "nombre", "organismo_o_juzgado", "destinatario", "persona_principal", "dni_cuit_cuil", "expediente",
    "caratula", "fecha", "monto", "cuenta_cbu_cvu_alias", "datos_solicitados", "email_respuesta", "observaciones", "calidad_ocr",
]
REVIEW_STATES = ["pendiente", "bien", "revisar", "corregir"]
TEXT_COLUMNS = {
    "selection": ["texto_limpieza_avanzada", "texto_limpio", "texto_base", "texto_ocr", "texto_markdown"],
    "quality": ["texto_limpio", "texto_markdown", "texto_ocr", "texto_original", "descripcion", "Description", "body", "texto"],
    "chunks": ["texto_limpieza_avanzada", "texto_limpio_avanzado", "texto_limpio", "texto_base", "texto", "texto_ocr", "contenido"],
    "simple": ["texto_limpieza_avanzada", "texto_limpio_avanzado", "texto_limpio", "texto_base", "texto", "contenido"],
    "rich": ["texto_limpieza_avanzada", "texto_limpio", "texto_ocr", "texto_base", "texto_markdown"],
}
MARKDOWN = ("# Documento legal\n\n## Metadatos\n\n* ID: ", "\n* Nombre: ", "\n* Clasificación: ", "\n\n## Texto limpio\n\n")

# Ligatures and their letters, curly quotes and their straight forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}
CURLY_QUOTES, STRAIGHT_QUOTES = "“”„‘’‚", "\"\"\"\'\'\'"

# ASCII spellings of letters and signs that have no base letter; lower case, as search keys are.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "º": "o", "ª": "a", "°": "deg", "€": "EUR",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "\"", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "і": "i", "є": "ie", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "–": "-", "—": "--", "…": "...", "•": "*", "«": "<<", "»": ">>", "¿": "?", "¡": "!", "©": "(c)", "®": "(r)", "“": "\"", "”": "\"", "‘": "'", "’": "'", "⁄": "/",
}
