"""Fixed values of the scheduling domain.

These lists, maps and patterns are data, not logic: results depend on them
being exactly these, so they are stated here once, as plain text.
"""

# ---------------------------------------------------------------- fixed values
STATUS_TEXT = {
    "p": "requested",
    "t": "scheduled",
    "a": "registered",
    "b": "started",
    "u": "examined",
    "d": "dictated",
    "s": "canceled",
    "f": "verified",
    "g": "deleted",
    "w": "waiting",
}

RELEVANT_MACHINES = ["MR1", "MR2", "MRDL"]
EXCLUDED_SERVICES = ["Zweitbefundung MR", "Fremduntersuchung MR"]
PATIENT_ID_SUFFIX = "|USZ"
TEST_PATIENT_PREFIX = "SMS"

PATIENT_CLASS = {
    "ambulant": "ambulant",
    "stationär": "inpatient",
    "teilstationär": "inpatient",
}

# Column conventions of the raw export.
DATE_TIME_MARKER = "DtTm"
RAW_DATE_COLUMNS = ["DateOfBirth"]
RAW_DROP_COLUMNS = ["PlacerOrderNo", "StationTelefon"]
RAW_NUMERIC_TEXT_COLUMNS = ["Zip"]
RAW_TEXT_COLUMNS = [
    "History_OrderStatus", "OrderStatus", "PatientClass", "SAP FallArt", "Klasse", "InstituteID",
    "InstituteDivisionID", "EnteringOrganisationDeviceID", "UniversalServiceId", "UniversalServiceName",
    "DangerCode", "Sex", "Beruf", "Staatsangehoerigkeit", "WohnadrOrt", "WohnadrPLZ", "City", "Zivilstand",
    "Sprache", "MRNCmpdId", "StationName", "ApprovalStatusCode", "PerformProcedureID", "PerformProcedureName",
    "SourceFeedName", "ReasonForStudy",
]
END_OF_TIME_TEXT = "9000-01-01 00:00:00.0000000"
MAX_YEAR = 2100
YEAR_PATTERN = r".*([1-3][0-9]{3})"

INSURANCE_CLASS = {"A": "general", "P": "private", "HP": "half private"}
MARITAL = {
    "VRH": "married",
    "LED": "single",
    "GES": "divorced",
    "UNB": "not known",
    "XXX": "not known",
    "VRW": "widowed",
    "GTR": "unable to translate",
    "PAR": "partnership",
}
FEMALE = "weiblich"
CLOSE_KM = 16

# Image stations kept, with their device number.
STATION_DEVICE = {"MT00000173": 1, "MT00000213": 2}
BOOK_DEVICE = {"MR1": 1, "MR2": 2}
WEEKDAY_CODE = {"MO": "Monday", "DI": "Tuesday", "MI": "Wednesday", "DO": "Thursday", "FR": "Friday"}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
VALID_FROM_DEFAULT = "01.01.2014"
VALID_TO_DEFAULT = "31.12.2055"
CALENDAR_START = "2014-01-01"
CALENDAR_YEARS_AHEAD = 3

IMAGE_GAP_SECONDS = 1800
EDGE_IMAGES = 5
BUFFER_MINUTES = 5
SLOT_MINUTES = 30

# Rules are (pattern, label); of several matching rules the last one counts.
MODALITY_RULES = [
    ("becken", "back"),
    ("leber", "liver"),
    ("niere", "kidney"),
    ("hand|finger|ellbogen|vorderarm|oberarm|obere extremität", "arm"),
    ("abdomen|thorax|hüfte|MR TOS", "midsection"),
    ("schenkel", "leg"),
    ("ganzkörper|ganzkvrper", "full_body"),
    ("schädel|schadel|gehirn|felsenbein", "head"),
    ("herz", "heart"),
    ("Pankreas|Dünndarm|Milz|MRCP", "organ"),
    ("Intervention", "intervention"),
    ("Neurographie|Magnetresonanztomographie", "general"),
    ("Angio", "angiography"),
    ("Arthrographie", "joint"),
    ("venograp|Phlebographie", "veins"),
    ("Mamma", "mammography"),
    ("Prostata", "prostate"),
    ("Hals", "throat"),
    ("Defäkographie", "defecography"),
    ("LWS|BWS|HWS", "spine"),
    ("schulter", "shoulder"),
    ("knie", "knee"),
    ("fuss", "foot"),
]

OCCUPATION_RULES = [
    ("Angestellte|ang.|baue|angest.|Hauswart|dozent|designer|^KV$|masseu|Raumpflegerin|Apothekerin|Ing.|fotog|"
     "Psycholog|Sozialpädagoge|Werkzeu|druck|musik|koordinator|software|schaler|Kosmetikerin|Physiotherapeutin|"
     "Physiker|Unternehmer|Praktikant|Analy|reinig|Detailhandel|putz|Grafiker|anwält|maschinist|Immobilien|"
     "Zimmermann|schloss|Kassiererin|hotel|hochbau|marketing|engineer|IT|Rechts|backer|bäcker|baecker|Disponent|"
     "magazin|chemik|Journalist|Schreiner|metzg|Consultant|Berater|Köch|gärtn|gartn|gaertn|Professor|Praktikantin|"
     "Gipser|Küche|lehrl|logist|Buchhalter|technik|Projektleiter|Manager|Assistent|Landwirt|Poliz|Elektro|Elektri|"
     "Jurist|Kellner|Sekret|Lager|Monteur|Coiffeu|spengler|Kindergärtner|Geschäfts|mechanik|maurer|Maler|"
     "Chauffeur|ingenieur|Kauf|mitarbeiter|Verkäufer|Informatiker|koch|lehrer|arbeiter|architekt", "employed"),
    ("rentner|Renter|pensioniert|pens.|rente", "retired"),
    ("IV-Rentner", "iv_retired"),
    ("keine Angaben|keine Ang", "none_given"),
    ("student|Schüler|Doktorand|Kind|Stud.|Ausbildung|^MA$", "student"),
    ("^IV$|^IV-Bezüger|^$|arbeitslos|ohne Arbeit|ohne|o.A.|nicht Arbeitstätig|Sozialhilfeempfänger|o. Arbeit|"
     "keine Arbeit|Asyl|RAV", "unemployed"),
    ("Hausfrau|Hausmann", "stay_at_home_parent"),
    ("selbst", "self_employed"),
    ("arzt|aerzt|ärzt|pflegefachfrau|Pflegehelfer|MTRA|Erzieherin|Fachfrau Betreuung|Pflegefachmann|MPA|FaGe|"
     "Krankenschwester|Fachmann MTRA", "hospital_worker"),
    ("Tourist", "other"),
]

REASON_RULES = [
    ("verlauf", "verlaufskontrolle"),
    ("läsion|laesion", "lesion"),
    ("nachsorge", "aftercare"),
    ("ganzkörper", "full_body"),
    ("rezidiv", "relapse_check"),
    ("entzündliche veränderungen|entzuendliche veraenderungen", "entzuendliche_veraenderungen"),
    ("krebs|cancer|tumor|onkolog|HCC", "cancer"),
]

# Right-closed hour bins: label applies up to and including the hour.
TIME_OF_DAY_BINS = [(9, "early_morning"), (12, "late_morning"), (14, "lunchtime"), (17, "afternoon"),
                    (100, "evening")]
HOUR_PERIOD = 24
WEEKDAY_PERIOD = 5
MONTH_PERIOD = 12

# Observation log: status codes seen before and after the day.
OBS_PLANNED = ["ter", "anm"]
OBS_CAME = ["bef", "unt", "schr"]
OBS_RESET = "ter"
OBS_INPATIENT = "bef"
VALIDATION_OUTCOMES = ["show", "rescheduled", "canceled"]

FEEDBACK_IGNORED = ["appt not found", "delete"]
FEEDBACK_REACHED = {
    "control": "control",
    "comes": "reached",
    "not reached": "not reached",
    "to be rescheduled": "reached",
}
FEEDBACK_REACHED_2 = {
    "control": "control",
    "comes": "reached",
    "not reached": "control",
    "to be rescheduled": "reached",
}

PROBABILITY_FLOOR = 1e-5
APPOINTMENTS_PER_WEEK = 105
PREDICTIONS_STEP = 10
CALL_DAYS = {
    "Monday": (["Monday", "Tuesday", "Wednesday"], 6),
    "Thursday": (["Thursday", "Friday"], 4),
}
