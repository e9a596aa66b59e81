"""Vocabularies and weights of record enrichment."""

# fixed values: weakness ids and their groups
CWE_TOP_25 = [
    "CWE-787", "CWE-79", "CWE-89", "CWE-416", "CWE-78", "CWE-20", "CWE-125", "CWE-22", "CWE-352", "CWE-434", "CWE-862", "CWE-476", "CWE-287",
    "CWE-190", "CWE-502", "CWE-77", "CWE-119", "CWE-798", "CWE-918", "CWE-306", "CWE-362", "CWE-269", "CWE-94", "CWE-863", "CWE-276",
]
CWE_GROUPS = {
    "injection": ["CWE-79", "CWE-89", "CWE-78", "CWE-77", "CWE-94", "CWE-502"],
    "memory": ["CWE-787", "CWE-416", "CWE-125", "CWE-119", "CWE-190", "CWE-476"],
    "access_control": ["CWE-287", "CWE-306", "CWE-862", "CWE-863", "CWE-269", "CWE-798"],
    "path": ["CWE-22", "CWE-434", "CWE-276"],
    "web": ["CWE-79", "CWE-352", "CWE-918"],
    "input_validation": ["CWE-20", "CWE-190"],
    "crypto": ["CWE-327", "CWE-328", "CWE-329", "CWE-330", "CWE-326", "CWE-310", "CWE-311", "CWE-312", "CWE-313"],
    "concurrency": ["CWE-362"],
}
PUBLICATION_GROUPS = {
    "memory": ["787", "416", "125", "476", "119"],
    "injection": ["79", "89", "78", "77", "94"],
    "auth": ["287", "306", "862", "863"],
    "crypto": ["327", "328", "798"],
    "path": ["22", "434", "352"],
}

# fixed values: vendors
HIGH_RISK_VENDORS = ["microsoft", "cisco", "adobe", "oracle", "google", "apple", "linux", "apache", "mozilla", "atlassian", "gitlab", "jenkins", "vmware", "fortinet", "palo alto", "juniper"]
HEALTHCARE_VENDORS = [
    "philips", "ge healthcare", "ge medical", "siemens", "medtronic", "cerner", "epic", "allscripts", "mckesson", "baxter", "bd", "becton", "stryker",
    "abbott", "boston scientific", "drager", "draeger", "fresenius", "hospira", "smiths medical", "masimo", "nihon kohden", "mindray", "carestream", "agfa",
]
PUBLICATION_HIGH_RISK = ["microsoft", "cisco", "adobe", "oracle", "google", "apple", "linux", "apache", "mozilla", "atlassian", "gitlab", "jenkins"]
PUBLICATION_HEALTHCARE = [
    "philips", "ge healthcare", "siemens", "medtronic", "cerner", "epic", "allscripts", "mckesson", "baxter", "bd", "becton", "stryker",
    "abbott", "boston scientific", "drager", "fresenius", "hospira", "smiths medical", "masimo", "nihon kohden",
]

# fixed values: words of descriptions
DESCRIPTION_FLAGS = {
    "desc_has_rce": ["remote code execution", "rce", "arbitrary code execution", "execute arbitrary code"],
    "desc_has_auth_bypass": ["bypass authentication", "authentication bypass", "without authentication"],
    "desc_has_priv_esc": ["privilege escalation", "escalate privileges", "elevated privileges"],
    "desc_has_sqli": ["sql injection", "sqli", "sql query", "union select"],
    "desc_has_xss": ["cross-site scripting", "xss", "script injection"],
    "desc_has_dos": ["denial of service", "dos", "crash", "resource exhaustion"],
    "desc_has_buffer_overflow": ["buffer overflow", "buffer overrun", "heap overflow", "stack overflow"],
    "desc_has_path_traversal": ["path traversal", "directory traversal", "../", "dot dot"],
    "desc_has_csrf": ["csrf", "cross-site request forgery", "xsrf"],
    "desc_has_xxe": ["xxe", "xml external entity", "xml injection"],
}
KEYWORD_TIERS = {
    "high": [
        "remote code execution", "rce", "arbitrary code execution", "bypass authentication", "privilege escalation", "authentication bypass", "buffer overflow",
        "proof of concept", "poc", "exploit available", "actively exploited", "in the wild", "zero-day", "0day",
    ],
    "medium": ["denial of service", "dos", "information disclosure", "cross-site scripting", "xss", "sql injection", "code injection", "command injection", "path traversal"],
    "low": ["improper access control", "insufficient verification", "weak encryption", "missing validation"],
}

# fixed values: vendors, products and words of health care, in their order of priority
HEALTH_VENDOR_TERMS = {
    "ge_healthcare": ["ge healthcare", "ge medical", "gehc"],
    "philips": ["philips healthcare", "philips medical"],
    "siemens": ["siemens healthineers", "siemens medical"],
    "medtronic": ["medtronic"],
    "boston_scientific": ["boston scientific"],
    "abbott": ["abbott laboratories", "abbott"],
    "stryker": ["stryker"],
    "bd": ["becton dickinson", "bd", "carefusion"],
    "baxter": ["baxter"],
    "zimmer_biomet": ["zimmer biomet"],
    "epic": ["epic systems", "epic"],
    "cerner": ["cerner", "oracle health", "oracle cerner"],
    "meditech": ["meditech", "medical information technology"],
    "allscripts": ["allscripts"],
    "athenahealth": ["athenahealth"],
    "nextgen": ["nextgen healthcare"],
    "eclinicalworks": ["eclinicalworks"],
    "practice_fusion": ["practice fusion"],
    "agfa": ["agfa healthcare"],
    "fujifilm": ["fujifilm medical"],
    "carestream": ["carestream health"],
    "sectra": ["sectra"],
    "mckesson": ["mckesson"],
    "change_healthcare": ["change healthcare"],
    "optum": ["optum", "unitedhealth"],
    "nuance": ["nuance healthcare", "nuance communications"],
    "infor": ["infor healthcare"],
    "roche": ["roche diagnostics"],
    "quest": ["quest diagnostics"],
    "labcorp": ["laboratory corporation"],
    "beckman_coulter": ["beckman coulter"],
    "omnicell": ["omnicell"],
    "bd_rowa": ["bd rowa"],
    "arxium": ["arxium"],
    "scriptpro": ["scriptpro"],
    "teladoc": ["teladoc"],
    "amwell": ["american well", "amwell"],
    "zoom": ["zoom healthcare"],
    "workday": ["workday healthcare"],
    "kronos": ["kronos healthcare"],
}
HEALTH_PRODUCT_TERMS = {
    "ehr_emr": ["electronic health record", "electronic medical record", "ehr", "emr", "patient record system", "clinical information system"],
    "pacs": ["pacs", "picture archiving", "dicom", "medical imaging", "radiology information system", "ris"],
    "medical_devices": ["infusion pump", "ventilator", "patient monitor", "defibrillator", "mri", "ct scanner", "ultrasound", "x-ray", "anesthesia", "pacemaker", "insulin pump", "glucose monitor"],
    "pharmacy": ["pharmacy management", "medication dispensing", "pharmacy system", "drug information", "prescription"],
    "laboratory": ["laboratory information system", "lis", "lab analyzer", "diagnostic system", "specimen"],
    "telehealth": ["telemedicine", "telehealth", "remote patient monitoring", "virtual care", "patient portal"],
    "hospital_operations": ["nurse call system", "bed management", "admission discharge transfer", "adt system", "hospital information system", "his"],
}
HEALTH_KEYWORDS = [
    "patient", "medical", "clinical", "healthcare", "hospital", "health care", "physician", "nurse", "doctor", "diagnosis",
    "phi", "protected health information", "patient data", "medical record", "health information", "clinical data",
    "hipaa", "hitech", "hl7", "fhir", "dicom", "ihe",
    "radiology", "cardiology", "oncology", "emergency department", "intensive care", "icu", "operating room", "laboratory",
    "medical device", "diagnostic equipment", "imaging system", "infusion", "ventilator", "monitor",
    "ehr", "emr", "pacs", "ris", "lis", "his", "cpoe",
]
LABEL_NAMES = {0: "negligible", 1: "low", 2: "moderate", 3: "high", 4: "critical", 5: "confirmed"}

# fixed values: words that begin no phrase of a term list, and words one of which a fuzzy hit needs
TERM_STOP_WORDS = ["the", "and", "with", "for", "that", "this", "from", "firm", "initiated", "voluntary", "class", "device", "devices", "product", "report", "initial", "submission", "event", "unknown", "none", "other", "data"]
ANCHORS = ["healthcare", "hospital", "clinic", "patient", "clinical", "medical", "ehr", "emr", "pacs", "radiology", "dialysis", "catheter", "infusion", "insulin", "ventilator", "medtronic", "philips", "siemens"]

# fixed values: phrasings that name a vendor, in the order in which they are tried, and words that are none
VENDOR_PATTERNS = [r"^([a-z0-9_\-]+)\s+(?:before|through|prior)", r"in\s+([a-z0-9_\-]+)\s+(?:version|v\d)", r"([a-z0-9_\-]+)\s+(?:allows|has|contains)", r"^([a-z0-9_\-]+)\s+\d+\."]
NO_VENDORS = ["the", "a", "an", "in", "on"]
