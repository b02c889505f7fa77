"""Tables and texts that results must agree with. No logic here."""

from __future__ import annotations

# Source -> (priority, lower wins; reliability).
SOURCES = {
    "manual": (0, "1.00"), "recruiter_csv": (1, "1.00"), "resume_pdf": (2, "0.85"), "recruiter_notes": (3, "0.70"),
    "ats_json": (4, "0.80"), "linkedin": (5, "0.75"), "github": (6, "0.90"),
}
UNKNOWN_PRIORITY, UNKNOWN_RELIABILITY = 99, "0.50"

# Weight of each field in the overall confidence.
FIELD_WEIGHTS = {
    "full_name": "1.5", "emails": "1.5", "phones": "1.2", "location": "1.0", "headline": "0.8", "years_experience": "1.0",
    "skills": "1.2", "experience": "1.2", "education": "1.0", "links": "0.8",
}

# Spelling in lower case -> skill.
SKILLS = {
    "python": "Python", "python3": "Python", "py": "Python", "python 3": "Python",
    "javascript": "JavaScript", "js": "JavaScript", "java script": "JavaScript", "ecmascript": "JavaScript", "es6": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript",
    "java": "Java", "java8": "Java", "java 8": "Java", "java 11": "Java", "java 17": "Java",
    "go": "Go", "golang": "Go",
    "rust": "Rust", "rust-lang": "Rust",
    "c++": "C++", "cpp": "C++", "c plus plus": "C++",
    "c#": "C#", "csharp": "C#", "c sharp": "C#", ".net c#": "C#",
    "ruby": "Ruby", "ruby on rails": "Ruby", "ror": "Ruby",
    "scala": "Scala",
    "kotlin": "Kotlin",
    "swift": "Swift",
    "php": "PHP",
    "r": "R", "r-lang": "R", "r language": "R",
    "sql": "SQL",
    "mysql": "MySQL",
    "structured query language": "SQL",
    "react": "React", "reactjs": "React", "react.js": "React",
    "angular": "Angular", "angularjs": "Angular", "angular.js": "Angular",
    "vue.js": "Vue.js", "vue": "Vue.js", "vuejs": "Vue.js",
    "django": "Django",
    "flask": "Flask",
    "fastapi": "FastAPI", "fast api": "FastAPI",
    "spring boot": "Spring Boot", "springboot": "Spring Boot", "spring": "Spring Boot",
    "node.js": "Node.js", "node": "Node.js", "nodejs": "Node.js",
    "express.js": "Express.js", "express": "Express.js", "expressjs": "Express.js",
    "next.js": "Next.js", "next": "Next.js", "nextjs": "Next.js",
    "apache spark": "Apache Spark", "spark": "Apache Spark", "pyspark": "Apache Spark",
    "apache kafka": "Apache Kafka", "kafka": "Apache Kafka",
    "apache airflow": "Apache Airflow", "airflow": "Apache Airflow",
    "dbt": "dbt", "data build tool": "dbt",
    "tensorflow": "TensorFlow", "tf": "TensorFlow",
    "pytorch": "PyTorch", "torch": "PyTorch",
    "scikit-learn": "Scikit-learn", "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn",
    "pandas": "Pandas",
    "numpy": "NumPy",
    "matplotlib": "Matplotlib",
    "seaborn": "Seaborn",
    "xgboost": "XGBoost", "xgb": "XGBoost",
    "lightgbm": "LightGBM", "lgbm": "LightGBM",
    "hugging face": "Hugging Face", "huggingface": "Hugging Face", "transformers": "Hugging Face",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "pg": "PostgreSQL",
    "mongodb": "MongoDB", "mongo": "MongoDB",
    "redis": "Redis",
    "elasticsearch": "Elasticsearch", "elastic search": "Elasticsearch", "es": "Elasticsearch",
    "cassandra": "Cassandra", "apache cassandra": "Cassandra",
    "bigquery": "BigQuery", "big query": "BigQuery", "google bigquery": "BigQuery",
    "snowflake": "Snowflake",
    "redshift": "Redshift", "amazon redshift": "Redshift", "aws redshift": "Redshift",
    "aws": "AWS", "amazon web services": "AWS", "amazon aws": "AWS",
    "gcp": "GCP", "google cloud": "GCP", "google cloud platform": "GCP",
    "azure": "Azure", "microsoft azure": "Azure",
    "docker": "Docker",
    "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "terraform": "Terraform",
    "ansible": "Ansible",
    "ci/cd": "CI/CD", "cicd": "CI/CD", "ci cd": "CI/CD", "continuous integration": "CI/CD",
    "github actions": "GitHub Actions", "gh actions": "GitHub Actions",
    "jenkins": "Jenkins",
    "rest apis": "REST APIs", "rest": "REST APIs", "rest api": "REST APIs", "restful": "REST APIs", "restful api": "REST APIs",
    "graphql": "GraphQL",
    "microservices": "Microservices", "micro services": "Microservices", "micro-services": "Microservices",
    "agile": "Agile", "scrum": "Agile", "kanban": "Agile",
    "tdd": "TDD", "test driven development": "TDD", "test-driven development": "TDD",
    "machine learning": "Machine Learning", "ml": "Machine Learning",
    "deep learning": "Deep Learning", "dl": "Deep Learning",
    "data engineering": "Data Engineering", "data pipelines": "Data Engineering",
    "etl": "ETL", "elt": "ETL", "extract transform load": "ETL",
    "system design": "System Design", "distributed systems": "System Design",
}

# Column header in lower case -> field.
HEADERS = {
    "full_name": "full_name", "name": "full_name", "candidate_name": "full_name", "candidate name": "full_name", "full name": "full_name",
    "fullname": "full_name",
    "email": "email", "email_address": "email", "emailaddress": "email", "e-mail": "email", "emails": "email", "email address": "email",
    "phone": "phone", "phone_number": "phone", "phonenumber": "phone", "mobile": "phone", "mobile_number": "phone", "telephone": "phone",
    "contact": "phone", "phone number": "phone", "mobile number": "phone", "cell": "phone",
    "location": "location", "city": "location", "address": "location", "place": "location", "current_location": "location",
    "current location": "location", "city_country": "location",
    "linkedin_url": "linkedin_url", "linkedin": "linkedin_url", "linkedin_profile": "linkedin_url", "linkedin profile": "linkedin_url",
    "linkedin url": "linkedin_url", "linkedin_link": "linkedin_url",
    "headline": "headline", "title": "headline", "job_title": "headline", "current_title": "headline", "current title": "headline",
    "jobtitle": "headline", "position": "headline", "role": "headline", "designation": "headline",
    "skills": "skills", "skill_set": "skills", "skillset": "skills", "skill set": "skills", "technologies": "skills", "tech_stack": "skills",
    "techstack": "skills", "core_skills": "skills", "core skills": "skills", "key skills": "skills", "key_skills": "skills",
    "years_experience": "years_experience", "years experience": "years_experience", "total_experience": "years_experience",
    "total experience": "years_experience", "experience": "years_experience", "experience_years": "years_experience", "exp": "years_experience",
    "years_of_experience": "years_experience", "years of experience": "years_experience",
}

# Further name of a country -> ISO code.
COUNTRY_ALIASES = {
    "usa": "US", "u.s.a": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US",
    "uk": "GB", "u.k": "GB", "u.k.": "GB", "great britain": "GB",
    "uae": "AE", "u.a.e": "AE", "u.a.e.": "AE",
    "south korea": "KR",
    "north korea": "KP",
    "russia": "RU",
    "czech republic": "CZ",
    "taiwan": "TW",
    "hong kong": "HK",
    "iran": "IR",
    "syria": "SY",
    "vietnam": "VN",
}

# City -> ISO code of its country.
CITIES = {
    "bangalore": "IN", "bengaluru": "IN", "mumbai": "IN", "delhi": "IN", "hyderabad": "IN", "chennai": "IN", "pune": "IN", "kolkata": "IN",
    "new delhi": "IN", "noida": "IN", "gurgaon": "IN", "gurugram": "IN",
    "san francisco": "US", "new york": "US", "seattle": "US", "austin": "US", "boston": "US", "chicago": "US", "los angeles": "US",
    "london": "GB", "manchester": "GB", "edinburgh": "GB",
    "toronto": "CA", "vancouver": "CA", "montreal": "CA",
    "berlin": "DE", "munich": "DE", "frankfurt": "DE",
    "paris": "FR",
    "amsterdam": "NL",
    "stockholm": "SE",
    "singapore": "SG",
    "sydney": "AU", "melbourne": "AU",
    "dubai": "AE", "abu dhabi": "AE",
    "tokyo": "JP", "osaka": "JP",
    "beijing": "CN", "shanghai": "CN",
    "bangkok": "TH",
    "jakarta": "ID",
    "kuala lumpur": "MY",
}

# Official English name that differs from the JVM's -> ISO code.
OFFICIAL_COUNTRIES = {
    "korea, republic of": "KR",
    "korea, democratic people's republic of": "KP",
    "russian federation": "RU",
    "czechia": "CZ",
    "taiwan, province of china": "TW",
    "iran, islamic republic of": "IR",
    "syrian arab republic": "SY",
    "viet nam": "VN",
    "venezuela, bolivarian republic of": "VE",
    "tanzania, united republic of": "TZ",
    "bolivia, plurinational state of": "BO",
    "moldova, republic of": "MD",
    "lao people's democratic republic": "LA",
    "brunei darussalam": "BN",
    "türkiye": "TR",
}

# Words of names and dates.
PARTICLES = ("van", "de", "der", "den", "di", "da", "du", "des", "von", "zu", "la", "le", "les", "del")
PRESENT = ("present", "current", "now", "ongoing", "till date", "till now", "to date", "today", "—", "-")
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)

# Platform -> pattern, the first that occurs anywhere counts.
PLATFORMS = (
    ("linkedin", r"linkedin\.com"), ("github", r"github\.com"), ("gitlab", r"gitlab\.com"), ("twitter", r"twitter\.com|x\.com"),
    ("stackoverflow", r"stackoverflow\.com"), ("medium", r"medium\.com"), ("behance", r"behance\.net"), ("dribbble", r"dribbble\.com"), ("kaggle", r"kaggle\.com"),
)

# Patterns of résumé text.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?[0-9]{1,3}[\s\-.]?)?(?:\(?[0-9]{2,4}\)?[\s\-.]?)[0-9]{3,4}[\s\-.]?[0-9]{3,4}"
LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-]+"
GITHUB = r"(?:https?://)?(?:www\.)?github\.com/[\w\-]+"
URL = r"""https?://[^\s<>"{}|\\^\[\]`]+"""
HEADINGS = (
    ("skills", r"(?:technical\s+)?skills?(?:\s+[&/]?\s*\w+)?|(?:core\s+)?competenc(?:y|ies)|technologies|tech(?:nical)?\s+stack|tools\s+(?:&|and)\s+technologies"),
    ("experience", r"(?:professional\s+|work\s+)?experience|employment(?:\s+history)?|work\s+history|career\s+(?:history|summary)?"),
    ("education", r"education(?:al\s+background)?|academic(?:\s+background)?|qualifications?"),
    ("summary", r"(?:professional\s+)?summary|profile|objective|about(?:\s+me)?"),
)
MONTH_YEAR = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s,]+[0-9]{4}"
DATE = rf"{MONTH_YEAR}|[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}}"
DATE_RANGE = rf"({MONTH_YEAR}|[0-9]{{4}})\s*(?:–|—|-|·|•|to)\s*({MONTH_YEAR}|Present|Current|Now|[0-9]{{4}})"
DEGREE_LINE = r"\b(?:B\.?Tech|B\.?E|M\.?Tech|M\.?S|MBA|B\.?Sc|M\.?Sc|Ph\.?D|Bachelor|Master|Doctor)\b"
DEGREE = r"\b(B\.?Tech|B\.?E|M\.?Tech|M\.?S|MBA|B\.?Sc|M\.?Sc|Ph\.?D|Bachelor(?:\s+of\s+\w+)?|Master(?:\s+of\s+\w+)?|Doctorate)\b"
YEARS = r"\b(?:over|more than|about|around|approximately|nearly|almost|roughly)?\s*(?:([0-9]+(?:\.[0-9]+)?)\+?|(" + "|".join(NUMBER_WORDS[1:]) + r"))\s*(?:\+)?\s*years?\b"

# Numbering plan of the regions tried for a phone number: calling code, trunk prefix, pattern of the national number.
PHONE_REGIONS = {
    "IN": ("91", "0", "[6-9][0-9]{9}|[1-5][0-9]{9}"), "US": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"), "GB": ("44", "0", "[1-37][0-9]{9}|[1-9][0-9]{8}"),
    "AU": ("61", "0", "[2-478][0-9]{8}"), "CA": ("1", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"), "SG": ("65", "", "[3689][0-9]{7}"), "AE": ("971", "0", "5[0-9]{8}|[2-79][0-9]{7}"),
}

# Projected fields, in the order of the output.
FIELDS = (
    "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education",
    "overall_confidence", "warnings", "pipeline_version", "created_at",
)
