"""Word lists, aliases, labels and stacks.

Everything in this module is data that decides results, so it is stated as is.
The patterns are written for Java's regex dialect and are always applied with
case-insensitive Unicode matching unless noted.
"""

# --- fixed values: section headers -----------------------------------------

NICE_HEADERS = (
    r"Diferenciais?\s+(?:Valorizados?|Desej[áa]veis?)?",
    r"Requisitos\s+Desej[áa]veis?",
    r"Habilidades?\s+Desej[áa]veis?",
    r"Voc[êe]\s+se\s+destacar[áa]\s+se\s+tiver",
    r"Desej[áa]veis?:?",
    r"Desej[áa]vel:?",
    r"Diferenciais?:?",
)

SOFT_HEADERS = (
    r"Soft\s*[Ss]kills?",
    r"Habilidades?\s+Comportamentais?",
    r"Compet[êe]ncias?\s+Socioemocionais?",
)

ADDITIONAL_HEADERS = (r"Informa[çc][õo]es\s+adicionais",)

# --- fixed values: technologies, in matching order --------------------------

TECHNOLOGIES = (
    r"Python", r"Java(?:Script)?", r"TypeScript", r"C#", r"\.NET", r"PHP", r"Ruby", r"Go(?:lang)?",
    r"Kotlin", r"Swift", r"Rust", r"Scala",
    r"R",
    r"React\s+Native", r"Angular(?:\.?JS)?", r"React(?:\.?JS)?", r"Vue(?:\.?JS)?",
    r"Next(?:\.?JS)?", r"Nuxt(?:\.?JS)?",
    r"Tailwind(?:\s*CSS)?",
    r"HTML\d?", r"CSS\d?", r"SASS", r"SCSS",
    r"Node(?:\.?JS)?", r"Django", r"Flask", r"FastAPI",
    r"Spring(?:\s*Boot)?", r"Laravel", r"Express(?:\.?JS)?",
    r"Rails", r"Ruby\s+on\s+Rails",
    r"Apache", r"Nginx", r"Tomcat",
    r"Prisma", r"NextAuth(?:\.?JS)?", r"tRPC",
    r"JPA", r"Hibernate", r"Entity\s*Framework",
    r"JWT", r"OAuth",
    r"Redux", r"Zustand", r"Styled\s+Components", r"Design\s+Systems?",
    r"TensorFlow", r"PyTorch", r"scikit-?learn", r"Pandas", r"NumPy", r"Matplotlib",
    r"LangChain", r"LangGraph", r"LlamaIndex", r"Hugging\s*Face",
    r"Airflow", r"Spark", r"Hadoop", r"Databricks",
    r"AWS", r"Azure", r"GCP", r"Google\s+Cloud",
    r"Docker", r"Kubernetes", r"Terraform", r"Ansible",
    r"CI[/\-]CD", r"Jenkins", r"GitHub\s+Actions",
    r"MySQL", r"PostgreSQL", r"MongoDB", r"Redis", r"Oracle", r"SQL\s*Server", r"SQLite",
    r"DynamoDB", r"Cassandra", r"Elasticsearch",
    r"APIs?\s+REST", r"REST(?:ful)?(?:\s+APIs?)?", r"GraphQL", r"gRPC", r"Kafka", r"RabbitMQ",
    r"SOAP", r"Web\s*Services?",
    r"Git(?:Hub|Lab)?", r"Gitflow",
    r"Jira", r"Confluence",
    r"SAP(?: PI/PO| ERP)?",
    r"Scrum", r"Kanban", r"Clean\s+Architecture", r"SOLID", r"DDD", r"TDD",
    r"Selenium", r"Cypress", r"Jest", r"JUnit", r"Pytest",
    r"Firebase", r"Google\s+Analytics", r"GA",
    r"Microfrontends",
    r"Linux", r"Unix", r"Bash", r"PowerShell", r"Maven", r"Gradle",
    r"Xcode", r"TestFlight",
    r"Figma", r"Sketch",
)

# --- fixed values: soft skills ----------------------------------------------

SOFT_SKILLS = (
    r"comunica[çc][aã]o\s*(?:clara|eficaz|assertiva)?",
    r"lideran[çc]a",
    r"trabalho\s+em\s+equipe",
    r"autonomia",
    r"proatividade", r"proativo",
    r"organiza[çc][aã]o",
    r"criatividade",
    r"inova[çc][aã]o",
    r"gest[aã]o\s+do\s+tempo",
    r"flexibilidade",
    r"empatia",
    r"adaptabilidade",
    r"colabora[çc][aã]o",
    r"mentor(?:ia)?",
    r"resolu[çc][aã]o\s+de\s+problemas",
    r"pensamento\s+cr[íi]tico",
    r"intelig[êe]ncia\s+emocional",
    r"bom\s+humor",
    r"protagonismo",
    r"senso\s+de\s+dono",
    r"perfil\s+anal[íi]tico",
)

# --- fixed values: seniority ------------------------------------------------

SENIORITY = (
    r"Estagi[áa]r?io", r"J[úu]nior", r"Jr\.?", r"Pleno", r"Pl\.?", r"S[êe]nior", r"Sr\.?",
    r"Especialista", r"Consultor", r"Lideran[çc]a", r"Gerente", r"Diretor",
)

SENIORITY_LABELS = {
    "jr": "Júnior", "jr.": "Júnior", "júnior": "Júnior", "junior": "Júnior",
    "pl": "Pleno", "pl.": "Pleno", "pleno": "Pleno",
    "sr": "Sênior", "sr.": "Sênior", "sênior": "Sênior", "senior": "Sênior",
    "estagiário": "Estagiário", "estagiario": "Estagiário",
    "especialista": "Especialista",
}

# --- fixed values: experience, salary, contract -----------------------------

EXPERIENCE = (
    r"(?:M[íi]nimo\s+de\s+)?(\d+)\s*(?:a\s+(\d+)\s+)?\+?\s*anos?\s+de\s+experi[êe]ncia"
    r"(?:\s+(?:com|em|como)\s+[^,\.;]{0,60})?"
)
EXPERIENCE_LIMIT = 20

SALARY = (
    r"(?:R\$\s*[\d\.]+(?:,\d+)?(?:\s*[-–]\s*R\$\s*[\d\.]+(?:,\d+)?)?"
    r"|(?:sal[áa]rio|bolsa|remuner[aação]{3,9})[^R\n]{0,40}(?:R\$\s*[\d\.]+(?:,\d+)?|a\s+combinar))"
)

# the only case-sensitive one
CONTRACT = (
    r"[Cc]ontrata[çc][ãaAÃ][oO]\s*:\s*([A-Za-zÀ-ú \(\)/]+?)"
    r"(?=\s*[;\n\d]|\s{2,}|\s+[A-ZÁÉÍÓÚ]{2}|$)"
)

DEFAULT_CONTRACT = "CLT"
DEFAULT_TITLE = "Vaga sem título"

# --- fixed values: spelling (lower case) -> canonical name ------------------
# A spelling that is not listed is its own canonical name.

ALIASES = {
    "js": "javascript",
    "ts": "typescript",
    "node": "nodejs",
    "node.js": "nodejs",
    "nodej": "nodejs",
    "express.js": "express",
    "react.js": "react",
    "reactjs": "react",
    "react native": "react-native",
    "angular.js": "angular",
    "angularjs": "angular",
    "vue.js": "vue",
    "vuejs": "vue",
    "next": "nextjs",
    "next.js": "nextjs",
    "nuxt": "nuxtjs",
    "nuxt.js": "nuxtjs",
    "tailwind": "tailwindcss",
    "tailwind css": "tailwindcss",
    "styled components": "styled-components",
    "design system": "design-system",
    "design systems": "design-system",
    "c#": "csharp",
    ".net": "dotnet",
    "golang": "go",
    "spring boot": "spring-boot",
    "ruby on rails": "rails",
    "google cloud": "gcp",
    "ci/cd": "cicd",
    "ci-cd": "cicd",
    "github actions": "github-actions",
    "postgres": "postgresql",
    "mongo": "mongodb",
    "sql server": "sql-server",
    "rest": "rest-api",
    "rest api": "rest-api",
    "apis rest": "rest-api",
    "hugging face": "hugging-face",
    "google analytics": "google-analytics",
    "ga": "google-analytics",
}

# --- fixed values: canonical name -> display label --------------------------

LABELS = {
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "nodejs": "Node.js",
    "express": "Express.js",
    "react": "React",
    "react-native": "React Native",
    "angular": "Angular",
    "vue": "Vue.js",
    "nextjs": "Next.js",
    "nuxtjs": "Nuxt.js",
    "tailwindcss": "Tailwind CSS",
    "styled-components": "Styled Components",
    "design-system": "Design System",
    "python": "Python",
    "java": "Java",
    "csharp": "C#",
    "dotnet": ".NET",
    "php": "PHP",
    "ruby": "Ruby",
    "go": "Go",
    "kotlin": "Kotlin",
    "swift": "Swift",
    "rust": "Rust",
    "scala": "Scala",
    "django": "Django",
    "flask": "Flask",
    "fastapi": "FastAPI",
    "spring": "Spring",
    "spring-boot": "Spring Boot",
    "laravel": "Laravel",
    "rails": "Ruby on Rails",
    "aws": "AWS",
    "azure": "Azure",
    "gcp": "Google Cloud",
    "docker": "Docker",
    "kubernetes": "Kubernetes",
    "terraform": "Terraform",
    "ansible": "Ansible",
    "cicd": "CI/CD",
    "jenkins": "Jenkins",
    "github-actions": "GitHub Actions",
    "postgresql": "PostgreSQL",
    "mysql": "MySQL",
    "mongodb": "MongoDB",
    "redis": "Redis",
    "oracle": "Oracle",
    "sql-server": "SQL Server",
    "sqlite": "SQLite",
    "dynamodb": "DynamoDB",
    "cassandra": "Cassandra",
    "elasticsearch": "Elasticsearch",
    "rest-api": "REST API",
    "graphql": "GraphQL",
    "grpc": "gRPC",
    "kafka": "Kafka",
    "rabbitmq": "RabbitMQ",
    "soap": "SOAP",
    "git": "Git",
    "github": "GitHub",
    "gitlab": "GitLab",
    "gitflow": "Gitflow",
    "jira": "Jira",
    "confluence": "Confluence",
    "tensorflow": "TensorFlow",
    "pytorch": "PyTorch",
    "scikit-learn": "scikit-learn",
    "pandas": "Pandas",
    "numpy": "NumPy",
    "matplotlib": "Matplotlib",
    "langchain": "LangChain",
    "langgraph": "LangGraph",
    "llamaindex": "LlamaIndex",
    "hugging-face": "Hugging Face",
    "airflow": "Airflow",
    "spark": "Spark",
    "hadoop": "Hadoop",
    "databricks": "Databricks",
    "redux": "Redux",
    "zustand": "Zustand",
    "firebase": "Firebase",
    "google-analytics": "Google Analytics",
    "selenium": "Selenium",
    "cypress": "Cypress",
    "jest": "Jest",
    "junit": "JUnit",
    "pytest": "Pytest",
    "linux": "Linux",
    "unix": "Unix",
    "bash": "Bash",
    "powershell": "PowerShell",
    "maven": "Maven",
    "gradle": "Gradle",
    "xcode": "Xcode",
    "testflight": "TestFlight",
    "figma": "Figma",
    "sketch": "Sketch",
}

# --- fixed values: stacks and their canonical components --------------------
# T3 lists "tailwind", which is an alias and never a canonical name, so T3 can
# be partial but not complete. Kept, because it decides which posts are partial.

STACKS = {
    "MERN": ("mongodb", "express", "react", "nodejs"),
    "MEAN": ("mongodb", "express", "angular", "nodejs"),
    "MEVN": ("mongodb", "express", "vue", "nodejs"),
    "PERN": ("postgresql", "express", "react", "nodejs"),
    "LAMP": ("linux", "apache", "mysql", "php"),
    "LEMP": ("linux", "nginx", "mysql", "php"),
    "T3": ("typescript", "trpc", "tailwind", "nextjs", "prisma", "nextauth"),
    "JAMstack": ("javascript",),
    "Next.js": ("nextjs", "react"),
    "Nuxt": ("nuxtjs", "vue"),
    "Django": ("python", "django"),
    "Rails": ("ruby", "rails"),
}

PARTIAL_COVERAGE = 0.5

STACK_MENTIONS = (
    r"MERN", r"MEAN", r"MEVN", r"PERN", r"LAMP", r"LEMP", r"T3", r"JAMstack",
    r"Next\.?js\s+stack", r"Nuxt\s+stack", r"Django\s+stack", r"Rails\s+stack",
)

# --- fixed values: search terms ---------------------------------------------

DEFAULT_TERMS = (
    "Desenvolvedor",
    "Engenheiro de software",
    "Developer",
    "software engineer",
    "data science",
    "Cientista de dados",
    "Tech lead",
)

SEED_TERMS = (
    "Software Engineer",
    "Mobile Engineer",
    "Data Scientist",
    "Cientista de Dados",
    "Data Engineer",
    "Machine Learning Engineer",
    "ML Engineer",
    "AI Engineer",
    "DevOps",
    "Cloud Architect",
    "SRE",
    "QA Engineer",
    "Quality Assurance",
    "SDET",
    "Software",
    "Desenvolvedor",
    "Developer",
)

# --- fixed values: token labels ---------------------------------------------

NER_LABELS = (
    "O",
    "B-HARD_SKILL", "I-HARD_SKILL",
    "B-SOFT_SKILL", "I-SOFT_SKILL",
    "B-SALARY", "I-SALARY",
    "B-NIVEL", "I-NIVEL",
    "B-CONTRATO", "I-CONTRATO",
)

NOT_INFORMED = "não informado"
