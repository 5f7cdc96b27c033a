"""Vocabularies of the extractors.

Fixed values: these lists have to equal the ones the rules were defined with.
Long dictionaries (drug, lab and condition names) are parameters of the
extractors, given as a ``term`` relation; the lists here are short defaults.
"""

# Document type -> (pattern, weight), in order.
DOCUMENT_TYPES: dict[str, list[tuple[str, float]]] = {
    "Visit Note": [
        (r"\bvisit note\b", 0.40), (r"\boffice visit\b", 0.40), (r"\bclinic(al)? visit\b", 0.35),
        (r"\bfollow[- ]?up visit\b", 0.35), (r"\bprogress note\b", 0.12), (r"\bchief complaint\b", 0.12),
        (r"\bhistory of present illness\b", 0.12)],
    "Progress Note": [
        (r"\bprogress note\b", 0.40), (r"\bsoap note\b", 0.40), (r"\bdaily note\b", 0.35),
        (r"\bhospital day\b", 0.25), (r"\binpatient note\b", 0.35)],
    "Discharge Summary": [
        (r"\bdischarge summary\b", 0.40), (r"\bdischarge note\b", 0.40), (r"\bhospital course\b", 0.25),
        (r"\bdischarged (home|to)\b", 0.35), (r"\bdischarge (diagnosis|diagnoses)\b", 0.40),
        (r"\bdate of (admission|discharge)\b", 0.25), (r"\blength of stay\b", 0.25),
        (r"\bdischarge medications?\b", 0.25), (r"\bdischarge instructions?\b", 0.12)],
    "Consultation Note": [
        (r"\bconsultation (note|report|request)\b", 0.40), (r"\bconsult note\b", 0.40),
        (r"\breason for consult(ation)?\b", 0.40), (r"\breferring physician\b", 0.25),
        (r"\brequest for consultation\b", 0.40), (r"\bconsulted (by|for)\b", 0.25)],
    "Operative Report": [
        (r"\boperative report\b", 0.40), (r"\boperation performed\b", 0.40), (r"\bprocedure performed\b", 0.25),
        (r"\bpreoperative diagnosis\b", 0.40), (r"\bpostoperative diagnosis\b", 0.40),
        (r"\bintraoperative (finding|course)\b", 0.40), (r"\bsurgeon[:\s]", 0.25), (r"\bscrub (tech|nurse)\b", 0.40),
        (r"\bspecimen submitted\b", 0.35), (r"\bprocedure time\b", 0.25), (r"\bestimated blood loss\b", 0.40)],
    "Radiology Report": [
        (r"\bradiology report\b", 0.40), (r"\bradiology findings\b", 0.35), (r"\bimaging report\b", 0.35),
        (r"\bct (scan|of)\b", 0.25), (r"\bmri (brain|spine|abdomen|pelvis|chest|knee|shoulder|hip|of)\b", 0.25),
        (r"\bx[- ]?ray\b", 0.12), (r"\bultrasound (of|abdomen|pelvis|neck|breast)\b", 0.25),
        (r"\b(pet|spect) scan\b", 0.35), (r"\bnuclear medicine\b", 0.35), (r"\bcontrast[- ]enhanced\b", 0.35),
        (r"\bno intravenous contrast\b", 0.40), (r"\bclinical (history|indication)\b", 0.12), (r"\bcomparison\b", 0.12),
        (r"\btechnique\b", 0.12), (r"\bfindings?\b", 0.12), (r"\bimpression\b", 0.12)],
    "Pathology Report": [
        (r"\bpathology report\b", 0.40), (r"\bpathological diagnosis\b", 0.40),
        (r"\bgross (description|examination)\b", 0.40), (r"\bmicroscopic (description|examination)\b", 0.40),
        (r"\bhistopatholog(y|ical)\b", 0.40), (r"\bspecimen type\b", 0.35), (r"\bsynoptic report\b", 0.40),
        (r"\bclinical diagnosis\b", 0.12), (r"\bimmunohistochemistry\b", 0.40),
        (r"\bmargins? (clear|positive|negative)\b", 0.35), (r"\btumor (grade|stage|size)\b", 0.35)],
    "Lab Report": [
        (r"\blaboratory report\b", 0.40), (r"\blab(oratory)? results?\b", 0.35), (r"\btest name\b", 0.35),
        (r"\breference range\b", 0.40), (r"\bnormal (range|value)\b", 0.25), (r"\bunits?\b", 0.12),
        (r"\bcollection (date|time)\b", 0.35), (r"\bspecimen type\b", 0.25), (r"\bhigh\b.*\blow\b", 0.25)],
    "Emergency Department Note": [
        (r"\bemergency department\b", 0.40), (r"\bemergency room\b", 0.40), (r"\bed (note|visit|encounter)\b", 0.40),
        (r"\btriage (note|level|category)\b", 0.40), (r"\barrival (time|mode)\b", 0.25),
        (r"\bdisposition (from )?ed\b", 0.40), (r"\bems (arrival|transport|response)\b", 0.35)],
    "Telephone Encounter": [
        (r"\btelephone (encounter|call|note)\b", 0.40), (r"\bphone (call|consultation|note)\b", 0.40),
        (r"\bcalled (patient|the patient)\b", 0.40), (r"\bpatient called\b", 0.35),
        (r"\bmessage (left|taken|received)\b", 0.25)],
    "Prescription": [
        (r"\bprescription\b", 0.40), (r"\b(?:rx|℞)\b", 0.35), (r"\btake \d+\b", 0.25), (r"\bdispense\b", 0.35),
        (r"\brefills?\b", 0.35), (r"\bsig:\b", 0.40), (r"\bndc\b", 0.35), (r"\bquantity:?\s*\d+\b", 0.35)],
    "Nursing Note": [
        (r"\bnursing (note|assessment|care plan)\b", 0.40), (r"\bnurse (note|assessment)\b", 0.40),
        (r"\bshift (note|assessment|summary)\b", 0.40), (r"\bpatient (education|teaching)\b", 0.25),
        (r"\bturning (and repositioning|schedule)\b", 0.40), (r"\bfall (precautions?|risk)\b", 0.35),
        (r"\bintervention\b", 0.12), (r"\boutcome\b", 0.12)],
    "Physical Therapy Note": [
        (r"\bphysical therapy (note|evaluation|assessment|plan)\b", 0.40),
        (r"\bpt (evaluation|note|assessment|goals?)\b", 0.40), (r"\brange of motion\b", 0.25),
        (r"\bstrength testing\b", 0.35), (r"\bgait (analysis|training|pattern)\b", 0.35),
        (r"\bfunctional (mobility|assessment|goals?)\b", 0.35), (r"\btherapeutic (exercise|activity)\b", 0.35),
        (r"\brehabilitation\b", 0.12)],
    "Occupational Therapy Note": [
        (r"\boccupational therapy (note|evaluation)\b", 0.40), (r"\bot (evaluation|note|assessment|goals?)\b", 0.40),
        (r"\badl (assessment|training|performance)\b", 0.40), (r"\bactivities of daily living\b", 0.40),
        (r"\biadl\b", 0.35), (r"\bfine motor\b", 0.35)],
    "Mental Health Note": [
        (r"\bmental health (note|evaluation)\b", 0.40), (r"\bpsychiatric (note|evaluation|assessment|intake)\b", 0.40),
        (r"\bpsych(iatry)? note\b", 0.40), (r"\btherapy (note|session)\b", 0.35),
        (r"\bmental status (exam|examination)\b", 0.40), (r"\bsuicidal (ideation|risk)\b", 0.35),
        (r"\bhomicidal ideation\b", 0.35), (r"\bpsychosis\b", 0.25), (r"\bmood (and affect|assessment)\b", 0.25),
        (r"\bcognitive behavioral therapy\b", 0.35)],
    "Referral Letter": [
        (r"\breferral (letter|note|request|form)\b", 0.40), (r"\bplease (see|evaluate|assess) this (patient|pt)\b", 0.35),
        (r"\bi am referring\b", 0.40), (r"\bthank you for (seeing|evaluating|consulting)\b", 0.40),
        (r"\breason for referral\b", 0.40), (r"\bfamiliar (physician|doctor)\b", 0.25)],
    "Prior Authorization": [
        (r"\bprior auth(orization)?\b", 0.40), (r"\bpa (request|form|approval)\b", 0.35),
        (r"\binsurance (authorization|approval)\b", 0.35), (r"\bmedical necessity\b", 0.40),
        (r"\bpolicy number\b", 0.35), (r"\bcoverage (request|determination)\b", 0.35)],
    "Anesthesia Note": [
        (r"\banesthesia (note|record|plan|evaluation)\b", 0.40), (r"\bpreanesthesia\b", 0.40),
        (r"\bpostanesthesia\b", 0.40), (r"\bgeneral anesthesia\b", 0.35), (r"\bregional anesthesia\b", 0.35),
        (r"\bspinal (anesthesia|block)\b", 0.35), (r"\bepidural\b", 0.25),
        (r"\bairway (assessment|management|class)\b", 0.35), (r"\bmallampati\b", 0.40)],
    "Procedure Note": [
        (r"\bprocedure note\b", 0.40), (r"\bindications? (for procedure|for the procedure)\b", 0.35),
        (r"\bconsent obtained\b", 0.25), (r"\bsterile (prep|drape|technique)\b", 0.35),
        (r"\bsite (marked|confirmed|verified)\b", 0.35), (r"\bcomplication[s]? (none|none noted)\b", 0.25),
        (r"\bspecimen sent\b", 0.35)],
    "Vaccine Record": [
        (r"\bimmunization (record|history)\b", 0.40), (r"\bvaccine (record|history|administered)\b", 0.40),
        (r"\bvaccination\b", 0.35), (r"\blot number\b", 0.40), (r"\bmanufacturer[:\s]", 0.35),
        (r"\bvaccine information statement\b", 0.40), (r"\bvis date\b", 0.40)],
    "Care Plan": [
        (r"\bcare plan\b", 0.40), (r"\btreatment plan\b", 0.25), (r"\bgoals? of care\b", 0.40),
        (r"\bproblem list\b", 0.35), (r"\binterdisciplinary (plan|team)\b", 0.35),
        (r"\blong[- ]term (goal|objective)\b", 0.35), (r"\bshort[- ]term (goal|objective)\b", 0.35)],
}

# Section key -> aliases, in order.  Further sections (operative,
# discharge, exam and administrative ones) are passed in by the caller.
SECTIONS: dict[str, list[str]] = {
    "chief_complaint": ["chief complaint", "cc", "reason for visit", "presenting complaint", "presenting concern", "reason for encounter", "chief complaints"],
    "hpi": ["history of present illness", "hpi", "present illness", "history of presenting illness", "presenting history", "history of presenting complaint", "hpoc"],
    "past_medical_history": ["past medical history", "pmh", "medical history", "history", "past history", "previous medical history", "medical background"],
    "surgical_history": ["past surgical history", "surgical history", "psh", "prior surgeries", "past operations", "surgical background", "previous surgeries", "operative history"],
    "family_history": ["family history", "fhx", "fh", "family medical history", "family background", "hereditary history"],
    "social_history": ["social history", "shx", "sh", "social background", "lifestyle history", "tobacco history", "substance use history", "occupational history"],
    "allergies": ["allergy", "allergies", "drug allergies", "known allergies", "nkda", "nka", "no known allergies", "adverse reactions", "drug reactions", "medication allergies"],
    "medications": ["medication", "medications", "current medications", "home medications", "discharge medications", "prescriptions", "rx", "active medications", "medication list", "home meds", "medication reconciliation", "current meds", "outpatient medications"],
    "vitals": ["vitals", "vital signs", "vital", "measurements", "objective vital signs", "triage vitals", "vitals on arrival", "vs", "vital signs on admission"],
    "physical_exam": ["physical exam", "physical examination", "exam", "examination", "objective", "pe", "general examination", "physical findings"],
    "assessment": ["assessment", "impression", "diagnosis", "diagnoses", "dx", "clinical impression", "assessment and plan", "a/p", "clinical diagnosis", "differential diagnosis", "ddx"],
    "plan": ["plan", "treatment plan", "recommendations", "recommendation", "management plan", "disposition", "orders", "clinical plan", "therapeutic plan", "next steps"],
    "labs": ["labs", "laboratory", "lab results", "blood work", "test results", "laboratory results", "lab data", "laboratory studies", "diagnostic studies", "laboratory findings"],
    "imaging": ["imaging", "radiology", "xray", "x-ray", "ct", "mri", "ultrasound", "imaging studies", "imaging results", "radiological studies", "diagnostic imaging", "radiographic findings"],
    "procedure": ["procedure", "procedures", "operation", "surgery", "intervention", "surgical procedure"],
    "follow_up": ["follow up", "follow-up", "return to clinic", "rtc", "follow up instructions", "next appointment", "return precautions", "patient instructions"],
    "ros": ["review of systems", "ros", "systems review", "review of systems positive", "review of systems negative"],
    "technique": ["technique", "protocol", "scan parameters", "imaging protocol", "acquisition", "scan technique", "technical parameters", "procedure description", "contrast protocol"],
    "findings": ["findings", "observations", "radiological findings", "imaging findings", "scan findings", "mri findings", "ct findings"],
}

# Text patterns that mark a statement as negated.
NEGATION = [
    r"\bno\b", r"\bnot\b", r"\bnone\b", r"\bdenies\b", r"\bdenied\b", r"\bnegative for\b", r"\bnegative\b",
    r"\bwithout\b", r"\bw/o\b", r"\bno evidence of\b", r"\bno sign of\b", r"\bno signs of\b", r"\bruled out\b",
    r"\bexcluded\b", r"\bdiscontinued\b", r"\bdiscontinue\b", r"\bstopped\b", r"\bstop\b", r"\bno longer\b",
    r"\bintolerant to\b", r"\bintolerance to\b", r"\bcontraindicated\b", r"\ballergic to\b", r"\bnkda\b", r"\bnka\b",
    r"\babsent\b", r"\bnormal\b", r"\bclear\b", r"\bclear of\b", r"\bfree of\b", r"\bfree from\b",
]

# Vital sign -> pattern.
VITALS = {
    "blood_pressure": r"\b(?:bp|blood pressure)\s*[:\-]?\s*(\d{2,3})\s*/\s*(\d{2,3})\b",
    "heart_rate": r"\b(?:hr|heart rate|pulse|p)\s*[:\-]?\s*(\d{2,3})\s*(?:bpm)?\b",
    "temperature": r"\b(?:temp(?:erature)?|t)\s*[:\-]?\s*(\d{2,3}(?:\.\d+)?)\s*(?:f|c|°f|°c|fahrenheit|celsius)?\b",
    "respiratory_rate": r"\b(?:rr|respiratory rate|resp(?:iration)? rate|respirations?)\s*[:\-]?\s*(\d{1,3})\b",
    "oxygen_saturation": r"\b(?:spo2|o2 sat(?:uration)?|oxygen saturation|sat)\s*[:\-]?\s*(\d{2,3})\s*%?\b",
    "weight": r"\b(?:wt|weight)\s*[:\-]?\s*(\d{1,4}(?:\.\d+)?)\s*(?:kg|kgs|lbs?|pounds?)\b",
    "height": r"\b(?:ht|height)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:cm|m|meters?|ft|feet|inches?|in|'|\")",
    "bmi": r"\b(?:bmi|body mass index)\s*[:\-]?\s*(\d+(?:\.\d+)?)\b",
    "pain_score": r"\b(?:pain(?: score| level| scale)?|vas|nrs|numeric pain)\s*[:\-]?\s*(\d+)\s*(?:/\s*10)?\b",
    "gcs": r"\b(?:gcs|glasgow coma scale)\s*[:\-]?\s*(\d+)\b",
    "blood_glucose": r"\b(?:glucose|fbs|rbs|ppbs|blood sugar|cbg|fingerstick)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(?:mg/dl|mmol/l)?\b",
    "inr": r"\b(?:inr|(?:pt)(?:/inr)?)\s*[:\-]?\s*(\d+(?:\.\d+)?)\b",
}

# Word endings -> drug class.
DRUG_SUFFIXES = {
    "mab": "monoclonal antibody", "statin": "statin", "pril": "ACE inhibitor", "sartan": "ARB", "olol": "beta blocker",
    "dipine": "CCB-dihydropyridine", "floxacin": "fluoroquinolone", "cillin": "penicillin",
    "mycin": "macrolide/aminoglycoside", "cycline": "tetracycline", "azole": "azole antifungal/PPI",
    "gliptin": "DPP-4 inhibitor", "gliflozin": "SGLT2 inhibitor", "glutide": "GLP-1 agonist",
    "lukast": "leukotriene modifier", "tidine": "H2 blocker", "prazole": "proton pump inhibitor",
    "setron": "5-HT3 antagonist antiemetic", "tropin": "pituitary hormone", "parin": "heparin / LMWH",
    "dronate": "bisphosphonate", "vir": "antiviral", "fungin": "echinocandin antifungal",
}

# Laboratory names.
LAB_NAMES = [
    "hb", "hgb", "hemoglobin", "hct", "hematocrit", "wbc", "rbc", "platelet", "platelets", "neutrophils", "neutrophil", "lymphocytes", "lymphocyte",
    "monocytes", "monocyte", "eosinophils", "eosinophil", "basophils", "basophil", "bands", "reticulocytes", "mcv", "mch", "mchc", "rdw", "sodium",
    "na", "potassium", "k", "chloride", "cl", "bicarbonate", "co2", "hco3", "bun", "blood urea nitrogen", "creatinine", "calcium", "magnesium",
    "phosphorus", "glucose", "albumin", "protein", "total protein", "alt", "sgpt", "ast", "sgot", "alk phos", "alkaline phosphatase", "ggt", "ldh",
    "bilirubin", "total bilirubin", "direct bilirubin", "indirect bilirubin", "cholesterol", "total cholesterol", "triglycerides", "hdl", "ldl",
    "vldl", "non-hdl", "lipoprotein", "tsh", "t3", "t4", "free t3", "free t4", "ft3", "ft4", "pt", "ptt", "aptt", "inr", "fibrinogen", "d-dimer",
    "anti-xa", "troponin", "troponin i", "troponin t", "bnp", "nt-probnp", "ck", "creatine kinase", "ckmb", "ck-mb", "myoglobin", "lactic acid",
    "lactate", "crp", "c-reactive protein", "esr", "procalcitonin", "ferritin", "il-6", "gfr", "egfr", "cystatin c", "uric acid", "24h creatinine",
    "hba1c", "a1c", "insulin", "c-peptide", "cortisol", "acth", "prolactin", "fsh", "lh", "estradiol", "testosterone", "progesterone", "hcg",
    "beta-hcg", "igf-1", "dhea", "vitamin d", "25-oh vitamin d", "vitamin b12", "b12", "folate", "folic acid", "iron", "serum iron", "tibc",
    "transferrin", "zinc", "copper", "psa", "cea", "ca-125", "ca 125", "ca-19-9", "ca 19-9", "afp", "alpha fetoprotein", "ca-15-3", "her2", "ana",
    "anca", "anti-dsdna", "rf", "rheumatoid factor", "anti-ccp", "c3", "c4", "complement", "antiphospholipid", "anti-ro", "anti-la", "hiv", "hbsag",
    "hbs ag", "hcv", "hcv ab", "monospot", "cmv", "ebv", "ph", "pco2", "po2", "base excess", "pao2", "fio2", "ua", "urinalysis", "urine protein",
    "urine creatinine", "microalbumin", "urine culture", "urine glucose", "urine ketones", "blood culture", "sputum culture", "wound culture", "csf",
    "ammonia", "lead", "ethanol", "drug screen", "urine drug screen",
]

# Condition terms.
CONDITIONS = [
    "hypertension", "htn", "high blood pressure", "diabetes", "diabetes mellitus", "type 2 diabetes", "type 1 diabetes", "t2dm", "t1dm",
    "hyperlipidemia", "hypercholesterolemia", "dyslipidemia", "coronary artery disease", "cad", "ischemic heart disease", "ihd",
    "congestive heart failure", "chf", "heart failure", "hfref", "hfpef", "atrial fibrillation", "afib", "a-fib", "af", "myocardial infarction", "mi",
    "heart attack", "stemi", "nstemi", "stroke", "cva", "cerebrovascular accident", "tia", "transient ischemic attack", "peripheral vascular disease",
    "pvd", "peripheral artery disease", "pad", "deep vein thrombosis", "dvt", "pulmonary embolism", "pe", "chronic kidney disease", "ckd",
    "renal failure", "renal insufficiency", "acute kidney injury", "aki", "urinary tract infection", "uti", "pneumonia", "copd",
    "chronic obstructive pulmonary disease", "emphysema", "chronic bronchitis", "asthma", "sleep apnea", "obstructive sleep apnea", "osa", "anemia",
    "iron deficiency anemia", "thrombocytopenia", "hypothyroidism", "hyperthyroidism", "graves disease", "osteoporosis", "osteopenia",
    "osteoarthritis", "oa", "rheumatoid arthritis", "ra", "gout", "hyperuricemia", "fibromyalgia", "depression", "major depressive disorder", "mdd",
    "anxiety", "generalized anxiety disorder", "gad", "bipolar disorder", "bipolar", "schizophrenia", "ptsd", "post-traumatic stress disorder",
    "adhd", "attention deficit", "dementia", "cognitive impairment", "alzheimer", "alzheimer's disease", "parkinson", "parkinson's disease",
    "epilepsy", "seizure disorder", "migraine", "multiple sclerosis", "ms", "cellulitis", "sepsis", "septicemia", "bacteremia", "cancer", "carcinoma",
    "malignancy", "tumor", "malignant", "lymphoma", "leukemia", "myeloma", "breast cancer", "lung cancer", "colon cancer", "colorectal cancer",
    "prostate cancer", "ovarian cancer", "cervical cancer", "hepatocellular carcinoma", "hcc", "gerd", "gastroesophageal reflux", "acid reflux",
    "peptic ulcer", "gastric ulcer", "duodenal ulcer", "crohn's disease", "crohn disease", "ulcerative colitis", "inflammatory bowel disease",
    "irritable bowel syndrome", "ibs", "pancreatitis", "hepatitis", "hepatitis b", "hepatitis c", "cirrhosis", "liver failure", "cholelithiasis",
    "gallstones", "cholecystitis", "appendicitis", "diverticulitis", "diverticulosis", "obesity", "morbid obesity", "overweight", "chronic pain",
    "neuropathy", "peripheral neuropathy", "diabetic neuropathy", "radiculopathy", "herniated disc", "disc herniation", "disc bulge",
    "spinal stenosis", "scoliosis", "fracture", "dislocation", "rotator cuff", "rotator cuff tear", "acl tear", "meniscal tear", "cataracts",
    "glaucoma", "macular degeneration", "retinopathy", "diabetic retinopathy", "hypertriglyceridemia", "metabolic syndrome", "fatty liver", "nafld",
    "nash", "hiv", "aids", "covid", "covid-19", "influenza", "flu",
]

# A short default: drug dictionaries are a parameter, a relation of terms.
MEDICATIONS = ["metformin", "lisinopril", "atorvastatin", "amlodipine", "aspirin", "insulin", "warfarin", "heparin",
               "furosemide", "omeprazole", "amoxicillin", "prednisone", "levothyroxine", "gabapentin", "albuterol"]

# Words of the line rules and their patterns.
IMAGING = (r"\b(x[- ]?ray|radiograph|chest x[- ]?ray|cxr|ct(?: scan)?|cat scan|computed tomography|mri|magnetic resonance|"
           r"ultrasound|usg|sonography|echo|echocardiogram|pet(?: scan)?|spect|nuclear medicine|fluoroscopy|mammogram|"
           r"mammography|bone scan|dexa|densitometry|angiogram|angiography|venogram|eeg|emg|nerve conduction)\b")
PROCEDURE = (r"\b(surgery|operation|procedure|biopsy|excision|resection|ablation|endoscopy|colonoscopy|bronchoscopy|"
             r"cystoscopy|angiography|angioplasty|stent(?:ing)?|catheterization|intubation|extubation|tracheostomy|"
             r"appendectomy|cholecystectomy|colectomy|arthroplasty|arthroscopy|laminectomy|discectomy|debridement|"
             r"amputation|dialysis|hemodialysis|plasmapheresis|transfusion|infusion|incision|drainage|i&d|suturing|repair|"
             r"cpr|cardioversion|defibrillation|injection|aspiration|paracentesis|thoracentesis|lumbar puncture|lp|"
             r"spinal tap|pacemaker|defibrillator|icd)\b")
NUM_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
CREDENTIAL = (r"\b[A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3},?\s*"
              r"(?:MD|DO|NP|PA|PA-C|APRN|CRNA|LCSW|RN|LPN|RPh|PharmD|DPM|OD|DDS|PhD|PsyD|CNM)\b")
FACILITY = (r"(?i)\b(hospital|clinic|medical center|healthcare|health system|nursing home|diagnostic(s)?|laboratory|lab|"
            r"imaging center|surgery center|cancer center|rehabilitation|rehab center|ambulatory)\b")

# Importance of an entity type.
IMPORTANCE = {
    "diagnosis_or_problem": 0.30, "past_diagnosis": 0.22, "diagnosis_code": 0.22, "vital": 0.20, "medication": 0.18,
    "lab_result": 0.18, "allergy": 0.15, "allergy_nkda": 0.08, "procedure": 0.15, "procedure_code": 0.12, "imaging": 0.10,
    "demographics_age": 0.07, "demographics_gender": 0.05, "demographics_dob": 0.09, "demographics_name": 0.05,
    "social_smoking": 0.08, "social_alcohol": 0.08, "social_substance": 0.10, "social_occupation": 0.04, "date": 0.05,
    "patient_identifier": 0.08, "medication_class": 0.10, "medication_candidate": 0.08,
    "medication_line_candidate": 0.06, "lab_reference_range": 0.05,
}
BOILERPLATE = ["page", "continued", "confidential", "document", "electronically", "signed", "printed", "generated", "report",
               "version", "copyright", "rights", "reserved", "disclaimer", "internal", "authorized", "personnel",
               "tel", "fax", "phone", "address", "zip", "suite"]
KEYWORDS = ["patient", "diagnosis", "medication", "treatment", "surgery", "procedure", "vital", "blood", "pressure", "heart",
            "rate", "temperature", "symptom", "complaint", "history", "exam", "lab", "imaging", "allergy", "dose",
            "hospital", "clinic", "physician", "nurse", "therapy"]
# Focus -> (sections, entity types, how many of them, words, how many of
# them, whether the words may stand inside others).
FOCUS = {
    "is_radiology_content": (
        ["imaging", "findings", "impression", "technique", "clinical_history", "comparison"], ["imaging"], 2,
        ["ct", "mri", "x-ray", "xray", "radiograph", "ultrasound", "pet", "spect", "fluoroscopy", "mammogram", "angiogram", "bone", "dexa",
         "scan", "imaging", "radiology", "nuclear", "contrast", "findings", "impression", "technique", "views", "projection",
         "lucency", "opacity", "hyperdense", "hypodense", "signal", "enhancement", "lesion", "nodule", "mass", "infiltrate", "effusion",
         "consolidation", "atelectasis", "pneumothorax", "fracture", "herniation", "stenosis", "occlusion"], 3, False),
    "is_operative_content": (
        ["operative_findings", "preoperative_diagnosis", "postoperative_diagnosis", "procedure_performed", "anesthesia", "procedure", "specimens", "complications"],
        ["procedure", "procedure_code"], 2,
        ["operative", "preoperative", "postoperative", "intraoperative", "surgery", "incision", "dissection", "excision", "resection",
         "anastomosis", "hemostasis", "closure", "drain", "specimen", "anesthesia", "surgeon", "estimated", "blood", "loss",
         "sterile", "prep", "drape", "cauterization", "laparotomy", "laparoscopy", "thoracotomy", "craniotomy"], 3, True),
    "is_medication_focused": (
        ["medications"], ["medication", "medication_class", "medication_candidate", "medication_line_candidate"], 3,
        ["mg", "mcg", "tablet", "capsule", "injection", "infusion", "dose", "daily", "bid", "tid", "qid", "prn", "po", "iv", "im",
         "subcutaneous", "topical", "sublingual", "transdermal", "patch", "prescription", "dispense", "refill", "sig", "pharmacy",
         "route", "frequency", "duration", "medication", "drug"], 4, False),
    "is_diagnostic_focused": (
        ["assessment", "impression", "plan", "chief_complaint", "hpi"], ["diagnosis_or_problem", "past_diagnosis", "diagnosis_code"], 2,
        ["diagnosis", "diagnoses", "assessment", "impression", "differential", "rule", "consistent", "suggestive", "etiology",
         "icd", "problem", "chief", "complaint", "history"], 2, True),
}
INFER_SECTION = [
    (r"\b(?:nkda|nka|allerg)\w*\b", "allergies"), (r"\b(?:chief complaint|reason for visit)\b", "chief_complaint"),
    (r"\b(?:history of present illness|hpi)\b", "hpi"), (r"\b(?:review of systems|ros)\b", "ros"),
    (r"\b(?:vital signs?|blood pressure|heart rate|rr)\b", "vitals"), (r"\b(?:physical exam|physical examination)\b", "physical_exam"),
    (r"\b(?:assessment|impression|diagnosis|diagnoses)\b", "assessment"), (r"\b(?:medication|drug|prescription|take tablet)\b", "medications"),
    (r"\b(?:lab(?:oratory)?|blood work|test result)\b", "labs"), (r"\b(?:ct|mri|x-?ray|ultrasound|imaging|radiology)\b", "imaging"),
    (r"\b(?:plan|recommendation|next step|follow.?up)\b", "plan"), (r"\b(?:family history|fhx)\b", "family_history"),
    (r"\b(?:social history|shx|tobacco|smoking|alcohol)\b", "social_history"), (r"\b(?:past medical history|pmh)\b", "past_medical_history"),
    (r"\b(?:discharge|hospital course|length of stay)\b", "hospital_course"),
    (r"\b(?:operative|surgery|procedure performed|preoperative|postoperative)\b", "procedure"),
]
# Flag -> (entity types, text pattern).
PRESENCE = {
    "contains_medication": (["medication", "medication_class", "medication_candidate", "medication_line_candidate"], r"\b(mg|mcg|tablet|capsule|injection|dose|daily|bid|tid|qid|prn)\b"),
    "contains_lab": (["lab_result", "lab_reference_range"], r"\b(hemoglobin|wbc|platelet|sodium|potassium|creatinine|bun|glucose|hba1c|cholesterol|troponin)\b"),
    "contains_diagnosis": (["diagnosis_or_problem", "past_diagnosis", "diagnosis_code"], r"\b(diagnosis|diagnoses|impression|assessment|history of|hx of|h/o|icd)\b"),
    "contains_vital": (["vital"], r"\b(bp|blood pressure|heart rate|hr|temperature|temp|rr|respiratory rate|spo2|o2 sat|weight|height|bmi|pain score|gcs)\b"),
    "contains_imaging": (["imaging"], r"\b(x[- ]?ray|ct|mri|ultrasound|xray|pet scan|nuclear medicine|mammogram|angiogram)\b"),
    "contains_procedure": (["procedure", "procedure_code"], r"\b(surgery|operation|biopsy|endoscopy|colonoscopy|catheterization|dialysis|procedure)\b"),
    "contains_date": (["date"], NUM_DATE),
    "contains_patient_id": (["patient_identifier"], r"\b(?:mrn|uhid|patient\s*id|account\s*no)\s*[:#\-]?\s*[a-z0-9]{4,20}\b"),
    "contains_negation": ([], r"\b(no|not|none|denies|negative for|without|w/o|ruled out)\b"),
    "contains_allergy": (["allergy", "allergy_nkda"], r"\b(allerg|nkda|nka|adverse reaction)\w*\b"),
    "contains_demographics": (["demographics_age", "demographics_gender", "demographics_dob", "demographics_name"], r"\b(\d{1,3})[- ]?(?:year[s]?[- ]?old|yo|y/?o)|dob|date of birth\b"),
}
