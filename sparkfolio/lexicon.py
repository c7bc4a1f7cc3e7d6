"""Default vocabularies and patterns.

Everything below is a set of fixed values: results depend on these exact words, weights and
patterns.  Callers can pass their own lists to every operator; these are only the defaults.
Profile catalogues (ids, aliases, detection keywords) are not shipped: they are caller data,
see ``sparkfolio.sources.profiles``.
"""

from __future__ import annotations

# --- fixed values: section names and the phrases that open them (first match wins) -----------
SECTION_PATTERNS: dict[str, str] = {
    "summary": r"^(summary|objective|profile|about me|professional summary|career objective|executive summary|about|profil|accroche|résumé|présentation|à propos)",
    "experience": r"^(experience|work experience|employment|professional experience|career history|work history|employment history|professional background|expérience|expériences professionnelles?|parcours professionnel)",
    "education": r"^(education|academic|qualification|academic background|educational background|studies|academic qualifications|formation|formations?|études|diplôme|diplômes?)",
    "skills": r"^(skills|technical skills|core competencies|competencies|expertise|technologies|tech stack|tools & technologies|key skills|compétences?|compétences techniques?|technologies?|qualités?|aptitudes?|atouts|savoir-être|savoir-faire)",
    "projects": r"^(projects|key projects|personal projects|professional projects|notable projects|side projects|projets?|réalisations?)",
    "certifications": r"^(certifications?|certificates?|awards?|achievements?|licenses?|accreditations?|certifications?|diplômes?|distinctions?)",
    "languages": r"^(languages?|spoken languages?|language skills?|langues?)",
    "interests": r"^(interests?|hobbies?|passions?|personal interests?|loisirs?|centres? d'intérêts?|activités? extra-professionnelles?|vie extra-professionnelle)",
    "contact": r"^(contact|contact information|contact details|personal information|personal details|coordonnées?|informations? personnelles?|informations? de contact)",
}

# --- fixed values: skills per category -------------------------------------------------------
SKILLS: dict[str, list[str]] = {
    "ml": ["tensorflow", "pytorch", "scikit-learn", "keras", "xgboost", "lightgbm", "hugging face",
           "transformers", "langchain", "llm", "nlp", "computer vision", "deep learning",
           "machine learning", "reinforcement learning", "openai", "llamaindex", "rag",
           "stable diffusion"],
    "mlops": ["mlflow", "kubeflow", "airflow", "docker", "kubernetes", "ci/cd", "github actions",
              "gitlab ci", "jenkins", "terraform", "helm", "ansible", "prefect", "dvc", "bentoml",
              "triton"],
    "cloud": ["aws", "azure", "gcp", "google cloud", "databricks", "snowflake", "bigquery",
              "sagemaker", "vertex ai", "azure ml"],
    "languages": ["python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "scala",
                  "r", "kotlin", "swift", "php", "ruby", "bash", "sql", "matlab", "julia"],
    "data": ["pandas", "numpy", "scipy", "postgresql", "mysql", "mongodb", "redis",
             "elasticsearch", "sqlite", "cassandra", "dbt", "neo4j", "dynamodb", "kafka", "spark",
             "hadoop", "tableau", "power bi", "looker", "plotly", "matplotlib", "seaborn",
             "polars"],
    "other": ["react", "vue", "angular", "django", "flask", "fastapi", "spring", "express",
              "next.js", "nuxt", "laravel", "rails", "asp.net", "git", "github", "gitlab", "jira",
              "confluence", "grafana", "prometheus", "datadog", "linux", "streamlit", "gradio"],
    "commerce": ["vente", "merchandising", "prospection", "négociation", "fidélisation",
                 "encaissement", "service client", "relation client", "conseil client",
                 "gestion de stock", "inventaire", "réassort", "sales", "customer service",
                 "retail", "cashier", "inventory management", "crm", "pos"],
}

# Order in which the categories of one record are flattened.
SKILL_FLAT_ORDER: list[str] = ["ml", "mlops", "cloud", "languages", "data", "other", "commerce"]

# --- fixed values: words that mark a job title -----------------------------------------------
TITLE_WORDS: list[str] = [
    "engineer", "developer", "scientist", "analyst", "manager", "designer", "architect",
    "consultant", "specialist", "lead", "director", "researcher", "administrator", "technician",
    "officer", "coordinator", "assistant", "operator",
    "ingénieur", "développeur", "analyste", "responsable", "chef", "concepteur", "chargé",
    "coordinateur", "gestionnaire", "technicien", "directeur", "superviseur", "formateur",
    "vendeur", "vendeuse", "conseiller", "conseillère", "commercial", "commerciale", "assistante",
    "opérateur", "opératrice", "hôte", "hôtesse", "caissier", "caissière", "logisticien",
    "magasinier", "stockman", "préparateur", "livreur", "agent", "chargée", "conducteur",
    "conductrice", "chauffeur", "chauffeure", "exploitant",
]

# --- fixed values: patterns of bullets, headings, title parts and names -----------------------
BULLET = r"^\s*[•–\-—▪◦◆▸→★*·]\s*"
TITLE_CASE_LINE = r"^[A-ZÀ-Ý][A-Za-zÀ-ÿ\s&/éèêàûùâôî]+$"
TITLE_SPLIT = r"\s+[-–—,]\s+|\s*\|\s*"
PERSON_WORD = r"^[A-Z][A-Za-zà-öù-ÿ'-]+$"

# --- fixed values: action words --------------------------------------------------------------
ACTION_VERBS_EN: list[str] = [
    "led", "built", "designed", "developed", "implemented", "optimized", "automated", "deployed",
    "architected", "mentored", "delivered", "reduced", "increased", "launched", "created",
    "managed", "improved", "established", "coordinated", "negotiated", "supervised", "trained",
    "analyzed", "engineered", "integrated", "migrated", "refactored", "streamlined",
    "accelerated", "achieved", "drove", "transformed", "scaled", "secured", "maintained",
    "produced", "published",
]
ACTION_VERBS_FR: list[str] = [
    "dirigé", "conçu", "développé", "implémenté", "optimisé", "automatisé", "déployé",
    "architecturé", "encadré", "livré", "réduit", "augmenté", "lancé", "piloté", "géré",
    "amélioré", "établi", "coordonné", "supervisé", "formé", "analysé", "intégré", "migré",
    "refactorisé", "accéléré", "réalisé", "transformé", "sécurisé", "maintenu", "produit", "créé",
    "mis en place", "assuré", "accompagné", "structuré",
]
ACTION_NOUNS_FR: list[str] = [
    "ingestion", "contrôle", "automatisation", "conception", "développement", "déploiement",
    "intégration", "optimisation", "coordination", "gestion", "supervision", "analyse",
    "création", "construction", "pilotage", "maintenance", "accompagnement", "migration",
    "consolidation", "paramétrage", "configuration", "modélisation", "suivi", "traitement",
    "extraction", "transformation",
]


def action_words(extra: list[str] | None = None) -> list[str]:
    """English and French verbs, French verbs without their final é, and action nouns."""
    words = ACTION_VERBS_EN + ACTION_VERBS_FR + [v.rstrip("é") for v in ACTION_VERBS_FR]
    words += ACTION_NOUNS_FR + [w.lower() for w in (extra or [])]
    return list(dict.fromkeys(words))


# --- fixed values: quantified results --------------------------------------------------------
METRIC_PATTERNS: list[str] = [
    r"\d+\s*%",
    r"(?i)\d+x\b",
    r"[$€£]\s*\d+",
    r"(?i)\d+\s*(users?|clients?|customers?|requests?|transactions?|utilisateurs?|clients?)",
    r"(?i)\b(increased|decreased|reduced|improved|grew|saved|generated|delivered)\b.{0,60}\d+",
    r"(?i)\b(augmenté|réduit|amélioré|généré|économisé|livré)\b.{0,60}\d+",
    r"(?i)\d+\s*(ms|seconds?|minutes?|hours?|days?|ms|heures?|jours?)\b",
    r"\d+\s*k\b|\d{4,}",
]

# --- fixed values: title synonyms and sector words (declared order decides) ------------------
TITLE_SYNONYMS: list[tuple[str, list[str]]] = [
    ("vendeur", ["conseiller de vente", "commercial terrain", "chargé de clientèle", "attaché commercial"]),
    ("développeur", ["software engineer", "ingénieur logiciel", "programmeur"]),
    ("data scientist", ["ml engineer", "ingénieur machine learning", "analyste data"]),
    ("conducteur", ["chauffeur", "transporteur", "livreur"]),
    ("opérateur", ["technicien de production", "agent de fabrication", "conducteur de ligne"]),
]
SECTOR_WORDS: list[tuple[str, list[str]]] = [
    ("magasin", ["magasin", "boutique", "grande distribution", "supermarché", "hypermarché", "enseigne"]),
    ("mode", ["mode", "textile", "prêt-à-porter", "habillement", "collection", "luxe", "maroquinerie"]),
    ("restauration", ["restauration", "restaurant", "cuisine", "hôtellerie", "fast-food", "café"]),
    ("transport", ["transport", "livraison", "logistique", "chauffeur", "fret", "supply chain"]),
    ("industrie", ["production", "fabrication", "industrie", "usine", "atelier", "manufacture"]),
    ("btp", ["btp", "chantier", "construction", "bâtiment", "travaux"]),
    ("santé", ["santé", "médical", "hôpital", "soins", "infirmier", "clinique", "pharmacie"]),
    ("finance", ["banque", "finance", "assurance", "comptabilité", "audit"]),
]

# --- fixed values: stop words of the keyword ranking -----------------------------------------
STOP_WORDS: list[str] = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "that",
    "this", "these", "those", "we", "you", "they", "it", "he", "she", "our", "your", "their",
    "its",
]

# --- fixed values: address words and words that are not places -------------------------------
STREET_WORDS: list[str] = [
    "rue", "avenue", "boulevard", "impasse", "allée", "chemin", "route", "place", "square",
    "passage", "voie", "résidence", "villa", "cité", "hameau", "lotissement", "lieu-dit",
    "jaurès", "jauress",
]
LOCATION_BLOCKLIST: list[str] = [
    "français", "anglais", "espagnol", "allemand", "italien", "portugais", "chinois", "japonais",
    "arabe", "russe", "néerlandais", "néerlandaise", "flamand", "catalan", "hindi", "coréen",
    "vietnamien", "turc", "polonais", "français natif", "anglais courant", "bilingue",
    "autonome", "rigoureux", "dynamique", "motivé", "passionné", "organisé", "polyvalent",
    "réactif", "créatif", "curieux", "ponctuel", "sérieux",
    "contact", "email", "adresse", "téléphone", "linkedin", "github", "mobile", "permis",
    "jaurès", "jean jaurès", "gambetta", "clemenceau", "foch", "de gaulle", "pasteur",
    "victor hugo", "napoleon",
]

# --- fixed values: qualification words -------------------------------------------------------
QUALIFICATION_WORDS: list[str] = [
    "caces", "habilitation", "habilité", "habilitation électrique", "permis",
    "carte professionnelle", "carte pro", "fimo", "fco", "carte conducteur", "bpjeps", "ssiap",
    "ssiap1", "ssiap2", "ssiap3", "haccp", "hygiène alimentaire", "carte t", "carte g",
    "loi hoguet", "autorisation de conduite", "agrément", "agrément préfectoral",
    "certification", "certifié", "diplôme d'état", "de infirmier", "attestation",
    "attestation de formation", "h0", "b0", "br", "bc", "b1", "b2", "hv", "be",
    "risque chimique", "travaux en hauteur", "port du harnais",
]

# --- fixed values: criteria ------------------------------------------------------------------
# criterion id -> (label, rule, default keywords)
CRITERION_DEFS: dict[str, tuple[str, str, list[str]]] = {
    "eval_experience": ("Expériences professionnelles", "has_experience", ["expérience", "emploi", "poste"]),
    "eval_formation": ("Formation académique", "has_education", ["formation", "diplôme", "école"]),
    "eval_summary": ("Accroche / profil", "has_summary", ["profil", "accroche", "objectif"]),
    "eval_dates": ("Datation des expériences", "has_dates", ["date", "période", "depuis"]),
    "eval_word_count": ("Volume du CV (≥ 300 mots)", "has_sufficient_words", []),
    "eval_contact": ("Coordonnées complètes", "has_contact", ["email", "téléphone"]),
    "eval_skills_tech": ("Compétences techniques", "has_tech_skills", []),
    "eval_skills_sector": ("Compétences sectorielles", "has_sector_skills", []),
    "eval_metrics": ("Résultats chiffrés", "has_metrics", []),
    "eval_projects": ("Projets réalisés", "has_projects", []),
    "eval_profile_keywords": ("Mots-clés métier", "has_profile_keywords", []),
    "eval_habilitations": ("Habilitations & certifications", "has_habilitations", ["habilitation", "certification", "permis"]),
    "eval_languages": ("Langues étrangères", "has_languages", ["anglais", "espagnol", "allemand"]),
}

# sector key -> [(criterion id, weight, required)]; every template sums to 100
SECTOR_TEMPLATES: dict[str, list[tuple[str, int, bool]]] = {
    "industrie_manufacturiere": [("eval_experience", 25, True), ("eval_habilitations", 20, True), ("eval_formation", 20, True), ("eval_skills_sector", 15, False), ("eval_dates", 10, False), ("eval_word_count", 10, False)],
    "btp": [("eval_experience", 25, True), ("eval_habilitations", 20, True), ("eval_formation", 20, True), ("eval_skills_sector", 20, False), ("eval_dates", 15, False)],
    "agroalimentaire": [("eval_experience", 25, True), ("eval_formation", 20, True), ("eval_habilitations", 20, True), ("eval_skills_sector", 20, False), ("eval_dates", 15, False)],
    "energie_environnement": [("eval_experience", 20, True), ("eval_formation", 20, True), ("eval_habilitations", 25, True), ("eval_skills_tech", 20, False), ("eval_dates", 15, False)],
    "commerce_distribution": [("eval_experience", 25, True), ("eval_formation", 15, True), ("eval_skills_sector", 20, True), ("eval_profile_keywords", 20, False), ("eval_metrics", 15, False), ("eval_word_count", 5, False)],
    "transport_logistique": [("eval_experience", 25, True), ("eval_habilitations", 25, True), ("eval_formation", 15, True), ("eval_dates", 20, False), ("eval_skills_sector", 15, False)],
    "hotellerie_restauration": [("eval_experience", 30, True), ("eval_formation", 20, True), ("eval_skills_sector", 20, False), ("eval_languages", 15, False), ("eval_word_count", 15, False)],
    "sante_social": [("eval_formation", 30, True), ("eval_experience", 20, True), ("eval_habilitations", 20, True), ("eval_skills_sector", 15, False), ("eval_summary", 15, False)],
    "education_formation": [("eval_formation", 30, True), ("eval_experience", 25, True), ("eval_summary", 20, False), ("eval_skills_sector", 15, False), ("eval_metrics", 10, False)],
    "securite": [("eval_experience", 25, True), ("eval_habilitations", 30, True), ("eval_formation", 20, True), ("eval_dates", 15, False), ("eval_word_count", 10, False)],
    "nettoyage_services": [("eval_experience", 30, True), ("eval_habilitations", 20, True), ("eval_formation", 20, True), ("eval_skills_sector", 15, False), ("eval_dates", 15, False)],
    "coiffure_esthetique": [("eval_formation", 30, True), ("eval_experience", 25, True), ("eval_skills_sector", 25, False), ("eval_summary", 10, False), ("eval_word_count", 10, False)],
    "immobilier": [("eval_experience", 25, True), ("eval_habilitations", 20, True), ("eval_formation", 15, True), ("eval_metrics", 20, False), ("eval_summary", 10, False), ("eval_word_count", 10, False)],
    "banque_assurance": [("eval_experience", 25, True), ("eval_formation", 25, True), ("eval_habilitations", 15, True), ("eval_metrics", 20, False), ("eval_summary", 15, False)],
    "finance_comptabilite": [("eval_experience", 25, True), ("eval_formation", 25, True), ("eval_habilitations", 10, False), ("eval_skills_tech", 20, False), ("eval_metrics", 20, False)],
    "rh_recrutement": [("eval_experience", 25, True), ("eval_formation", 20, True), ("eval_summary", 20, False), ("eval_skills_sector", 20, False), ("eval_metrics", 15, False)],
    "juridique_administratif": [("eval_experience", 25, True), ("eval_formation", 30, True), ("eval_skills_sector", 20, False), ("eval_summary", 15, False), ("eval_word_count", 10, False)],
    "marketing_communication": [("eval_experience", 25, True), ("eval_formation", 15, True), ("eval_projects", 20, False), ("eval_metrics", 20, False), ("eval_skills_tech", 10, False), ("eval_summary", 10, False)],
    "informatique_digital": [("eval_experience", 20, True), ("eval_formation", 15, True), ("eval_skills_tech", 20, True), ("eval_projects", 15, False), ("eval_profile_keywords", 15, False), ("eval_metrics", 10, False), ("eval_summary", 5, False)],
    "tourisme_loisirs": [("eval_experience", 25, True), ("eval_formation", 20, True), ("eval_languages", 25, False), ("eval_skills_sector", 20, False), ("eval_summary", 10, False)],
    "sport": [("eval_formation", 30, True), ("eval_experience", 25, True), ("eval_habilitations", 20, True), ("eval_skills_sector", 15, False), ("eval_summary", 10, False)],
    "culture_medias": [("eval_experience", 25, True), ("eval_projects", 25, False), ("eval_formation", 15, True), ("eval_skills_tech", 20, False), ("eval_summary", 15, False)],
    "artisanat": [("eval_experience", 30, True), ("eval_formation", 25, True), ("eval_habilitations", 20, True), ("eval_skills_sector", 15, False), ("eval_word_count", 10, False)],
}

# profile id -> template used instead of its sector's
PROFILE_OVERRIDES: dict[str, list[tuple[str, int, bool]]] = {
    "ml_engineer": [("eval_experience", 20, True), ("eval_formation", 15, True), ("eval_skills_tech", 25, True), ("eval_projects", 20, False), ("eval_profile_keywords", 10, False), ("eval_metrics", 5, False), ("eval_summary", 5, False)],
    "infirmier": [("eval_formation", 35, True), ("eval_experience", 25, True), ("eval_habilitations", 20, True), ("eval_skills_sector", 10, False), ("eval_summary", 10, False)],
    "chauffeur_pl": [("eval_experience", 20, True), ("eval_habilitations", 35, True), ("eval_formation", 15, True), ("eval_dates", 20, False), ("eval_skills_sector", 10, False)],
    "chauffeur_spl": [("eval_experience", 20, True), ("eval_habilitations", 35, True), ("eval_formation", 15, True), ("eval_dates", 20, False), ("eval_skills_sector", 10, False)],
    "electricien_batiment": [("eval_experience", 25, True), ("eval_habilitations", 30, True), ("eval_formation", 20, True), ("eval_skills_sector", 15, False), ("eval_dates", 10, False)],
    "cuisinier": [("eval_experience", 30, True), ("eval_formation", 25, True), ("eval_skills_sector", 25, False), ("eval_habilitations", 10, True), ("eval_word_count", 10, False)],
}

# Profile used when no profile is confident enough.
GENERIC_PROFILE_ID = "non_detecte"
GENERIC_SECTOR = "Générique"
GENERIC_TITLE = "Non détecté"
GENERIC_CRITERIA: list[tuple[str, str, int, bool, str, list[str]]] = [
    ("experience_presente", "Expérience professionnelle présente", 20, True, "has_experience", ["expérience", "experience", "poste", "emploi"]),
    ("formation_presente", "Formation / diplôme présent", 20, True, "has_education", ["formation", "diplôme", "étude", "école", "université"]),
    ("summary_presente", "Accroche / profil présent", 15, False, "has_summary", ["profil", "accroche", "présentation", "objectif"]),
    ("dates_coherentes", "Dates de parcours cohérentes", 15, True, "has_dates", ["date", "période", "durée", "depuis"]),
    ("word_count_300", "CV développé (≥ 300 mots)", 15, False, "has_sufficient_words", []),
    ("contact_complet", "Coordonnées de contact complètes", 15, False, "has_contact", ["email", "téléphone", "mobile", "adresse"]),
]

# --- fixed values: skill phrases -------------------------------------------------------------
# Leading verbs removed from occupation-skill titles.
SKILL_VERB_PREFIX = (
    r"^(use|apply|develop|create|manage|design|implement|build|configure|install|operate|write|"
    r"program|code|analys[ei]|work with|utiliz[ei]|employ|deploy|set up|set-up|execute|perform|"
    r"collect|process|handle|establish|report|interpret|extract|normalise|normalize|identify|"
    r"categori[sz][ei]|categoris[ei]|ensure|support|provide|document)\s+"
)
GENERIC_SKILL_WORDS: list[str] = [
    "data", "software", "systems", "process", "information", "services", "applications",
    "methods", "tools", "results", "requirements", "techniques",
]
TRIVIAL_OCCUPATION_WORDS: list[str] = [
    "engineer", "developer", "scientist", "analyst", "specialist", "technician", "manager",
    "officer", "consultant", "architect",
]
# category -> patterns looked for in a skill; the first category with a hit wins, else "other"
CATEGORY_PATTERNS: dict[str, list[str]] = {
    "ml": ["machine learning", "deep learning", "neural", "tensorflow", "pytorch", "keras",
           "scikit", "llm", "nlp", "computer vision", "reinforcement", "xgboost", "lightgbm",
           "transformers", "hugging face", "langchain", "rag", "stable diffusion", "bert", "gpt",
           "generative", "recommender", "classification", "clustering", "regression",
           "prediction model", "natural language", "statistical model", "machine translation",
           "image recognition", "pattern recognition"],
    "mlops": ["mlflow", "kubeflow", "airflow", "docker", "kubernetes", "ci/cd", "jenkins",
              "terraform", "helm", "ansible", "prefect", "dvc", "bentoml", "triton",
              "github actions", "gitlab ci", "pipeline", "deployment", "monitoring", "container",
              "orchestrat", "infrastructure", "continuous integration", "version control",
              "model deployment", "model monitoring"],
    "cloud": ["aws", "azure", "gcp", "google cloud", "databricks", "snowflake", "bigquery",
              "sagemaker", "vertex ai", "cloud computing", r"\bcloud\b", "cloud service",
              "cloud platform", "cloud storage", "serverless"],
    "languages": ["python", "java", "javascript", "typescript", r"\bc\+\+", r"\bc#", "golang",
                  "rust", "scala", "kotlin", "swift", "php", "ruby", "bash", "shell scripting",
                  "sql", "matlab", r"\br\b", "programming language", "scripting"],
    "data": ["pandas", "numpy", "scipy", "postgresql", "mysql", "mongodb", "redis",
             "elasticsearch", "cassandra", "dbt", "kafka", "spark", "hadoop", "tableau",
             "power bi", "looker", "plotly", "matplotlib", "seaborn", "polars", r"\bdata\b",
             "statistics", "analytical", "query language", "data warehouse", "data analysis",
             "data mining", "etl", "information extraction", "database scheme", "data quality",
             "data model", "data process", "data collection", "online analytical",
             "business intelligence", "statistical analysis", "unstructured data", "big data"],
}

# --- fixed values: phrases that open a section in flat, unpunctuated text (longest first per section)
FLAT_SECTION_PHRASES: list[tuple[str, str]] = [
    ("summary", "professional summary"), ("summary", "career objective"),
    ("summary", "executive summary"), ("summary", "summary"),
    ("experience", "professional experience"), ("experience", "work experience"),
    ("experience", "work history"), ("experience", "employment history"),
    ("experience", "career history"), ("experience", "experience"),
    ("skills", "technical skills"), ("skills", "key skills"), ("skills", "core competencies"),
    ("skills", "general skills"), ("skills", "skills"),
    ("education", "education"),
    ("projects", "key projects"), ("projects", "personal projects"), ("projects", "projects"),
    ("certifications", "certifications"), ("certifications", "certificates"),
    ("certifications", "certification"),
    ("languages", "languages"), ("interests", "interests"),
]

# --- fixed values: listing sources (name, colour) in query order -----------------------------
LISTING_SOURCES: list[tuple[str, str]] = [
    ("adzuna", "#6366f1"), ("jooble", "#10b981"), ("france_travail", "#2563eb"),
]
