"""Rule tables of the analyser.

FIXED VALUES. Everything in this module is a value that must equal the
behaviour being reproduced (extension maps, file-name lists, keyword lists,
score weights, quotas and report texts). They are listed plainly and in their
natural order; the operators turn them into small broadcast DataFrames or
literal column expressions. Nothing here grows with the data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: suffix -> language (42 entries, structure analysis vocabulary)
# ---------------------------------------------------------------------------
LANGUAGE_EXTENSIONS: dict[str, str] = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "React",
    ".tsx": "React/TypeScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".h": "C/C++ Header",
    ".hpp": "C++ Header",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
    ".rb": "Ruby",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".r": "R",
    ".m": "Objective-C",
    ".mm": "Objective-C++",
    ".sh": "Shell",
    ".bash": "Bash",
    ".ps1": "PowerShell",
    ".sql": "SQL",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "Less",
    ".xml": "XML",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".toml": "TOML",
    ".ini": "INI",
    ".cfg": "Config",
    ".conf": "Config",
    ".dockerfile": "Dockerfile",
    ".md": "Markdown",
    ".rst": "reStructuredText",
    ".tex": "LaTeX",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: exact file name -> configuration purpose (42 entries)
# ---------------------------------------------------------------------------
CONFIG_FILES: dict[str, str] = {
    "package.json": "Node.js dependencies",
    "requirements.txt": "Python dependencies",
    "Pipfile": "Python dependencies (pipenv)",
    "poetry.lock": "Python dependencies (poetry)",
    "Cargo.toml": "Rust dependencies",
    "go.mod": "Go modules",
    "pom.xml": "Java Maven dependencies",
    "build.gradle": "Java Gradle dependencies",
    "Gemfile": "Ruby dependencies",
    "composer.json": "PHP dependencies",
    "pubspec.yaml": "Dart/Flutter dependencies",
    "Package.swift": "Swift dependencies",
    "setup.py": "Python package setup",
    "setup.cfg": "Python package configuration",
    "pyproject.toml": "Python project configuration",
    "Dockerfile": "Container configuration",
    "docker-compose.yml": "Multi-container setup",
    "docker-compose.yaml": "Multi-container setup",
    ".gitignore": "Git ignore rules",
    ".dockerignore": "Docker ignore rules",
    "Makefile": "Build automation",
    "CMakeLists.txt": "CMake build configuration",
    "webpack.config.js": "Webpack configuration",
    "rollup.config.js": "Rollup configuration",
    "vite.config.js": "Vite configuration",
    "next.config.js": "Next.js configuration",
    "nuxt.config.js": "Nuxt.js configuration",
    "angular.json": "Angular configuration",
    "vue.config.js": "Vue.js configuration",
    "svelte.config.js": "Svelte configuration",
    "tsconfig.json": "TypeScript configuration",
    "jsconfig.json": "JavaScript configuration",
    ".eslintrc.json": "ESLint configuration",
    ".prettierrc": "Prettier configuration",
    "tox.ini": "Python testing configuration",
    "pytest.ini": "Pytest configuration",
    "jest.config.js": "Jest testing configuration",
    "cypress.json": "Cypress testing configuration",
    ".travis.yml": "Travis CI configuration",
    ".github/workflows": "GitHub Actions",
    "action.yml": "GitHub Action definition",
    "action.yaml": "GitHub Action definition",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: five file categories (classify_files)
# ---------------------------------------------------------------------------
CONFIG_NAME_WORDS = ["config", "conf", ".env", "settings", "properties"]
DOC_NAME_WORDS = [
    "readme", "changelog", "license", "contributing", "code_of_conduct",
    "authors", "contributors", "install", "usage", "api", "docs",
]
DOC_ENDINGS = [".md", ".rst", ".txt", ".adoc"]
TEST_PATH_WORDS = ["test", "spec", "__tests__", "tests", "testing"]
TEST_NAME_WORDS = ["test_", "_test", ".test.", ".spec."]
BUILD_NAME_WORDS = [
    "makefile", "cmake", "build", "grunt", "gulp", "webpack",
    "rollup", "vite", "parcel", "babel", "eslint", "prettier",
]
BUILD_ENDINGS = [".xml", ".gradle", ".sbt"]
CATEGORIES = ["source", "test", "config", "documentation", "build"]

# ---------------------------------------------------------------------------
# FIXED VALUES: listing filter and priority (filter_files, with_priority_score)
# ---------------------------------------------------------------------------
EXCLUDED_DIRS = [
    ".git", "node_modules", "__pycache__", ".pytest_cache",
    "venv", "env", ".env", "dist", "build", "target",
    ".next", ".nuxt", "coverage", ".coverage", "htmlcov",
]
EXCLUDED_EXTENSIONS = [
    ".pyc", ".pyo", ".pyd", ".class", ".o", ".so", ".dll",
    ".exe", ".bin", ".jar", ".war", ".ear", ".zip", ".tar",
    ".gz", ".rar", ".7z", ".pdf", ".doc", ".docx", ".xls",
    ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif",
    ".bmp", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov",
    ".wmv", ".flv", ".webm", ".ogg", ".wav", ".flac",
]
HIDDEN_ALLOWED = [
    ".gitignore", ".env.example", ".dockerignore",
    ".eslintrc.json", ".prettierrc", ".travis.yml",
]
PRIORITY_KEY_NAMES = ["readme.md", "package.json", "requirements.txt", "dockerfile", "makefile"]
PRIORITY_CONFIG_WORDS = ["config", ".env", "settings"]
PRIORITY_SOURCE_EXTS = [".py", ".js", ".ts", ".java", ".cpp", ".c", ".go", ".rs", ".rb", ".php"]
PRIORITY_TEST_WORDS = ["test", "spec"]
PRIORITY_DOC_EXTS = [".md", ".rst", ".txt"]
# weights: key name, config word, source ext, test word, doc ext, root level
PRIORITY_WEIGHTS = {"key": 100, "config": 50, "source": 30, "test": 20, "doc": 15, "root": 25}

# ---------------------------------------------------------------------------
# FIXED VALUES: comment rules per language (file_metrics); default '#' or '//'
# Each entry is a list of line prefixes that follow optional leading space.
# ---------------------------------------------------------------------------
COMMENT_PREFIXES: dict[str, list[str]] = {
    "Python": ["#", '"""', "'''"],
    "JavaScript": ["//", "/*", "*"],
    "TypeScript": ["//", "/*", "*"],
    "Java": ["//", "/*", "*"],
    "C++": ["//", "/*", "*"],
    "C": ["//", "/*", "*"],
    "Go": ["//", "/*", "*"],
    "Rust": ["//", "/*", "*"],
    "Ruby": ["#"],
    "PHP": ["//", "/*", "*", "#"],
    "Shell": ["#"],
    "Bash": ["#"],
    "PowerShell": ["#"],
    "HTML": ["<!--"],
    "CSS": ["/*", "*"],
}
DEFAULT_COMMENT_PREFIXES = ["#", "//"]
LARGE_FILE_LINES = 500
DEEP_NESTING_LEVEL = 6

# Characters Python's str.strip()/str.isspace() treat as white space.
PY_WHITESPACE_CODEPOINTS = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

# ---------------------------------------------------------------------------
# FIXED VALUES: package-name tooling groups (identify_tooling)
# ---------------------------------------------------------------------------
FRAMEWORK_PATTERNS: dict[str, list[str]] = {
    "React": ["react", "@types/react"],
    "Vue.js": ["vue", "@vue/"],
    "Angular": ["@angular/", "angular"],
    "Express.js": ["express"],
    "Next.js": ["next"],
    "Nuxt.js": ["nuxt"],
    "Svelte": ["svelte"],
    "Django": ["django"],
    "Flask": ["flask"],
    "FastAPI": ["fastapi"],
    "Spring": ["spring"],
    "Rails": ["rails"],
    "Laravel": ["laravel"],
}
TESTING_PATTERNS: dict[str, list[str]] = {
    "Jest": ["jest"],
    "Mocha": ["mocha"],
    "Chai": ["chai"],
    "Cypress": ["cypress"],
    "Puppeteer": ["puppeteer"],
    "Playwright": ["playwright"],
    "pytest": ["pytest"],
    "unittest": ["unittest"],
    "JUnit": ["junit"],
}
BUILD_TOOL_PATTERNS: dict[str, list[str]] = {
    "Webpack": ["webpack"],
    "Rollup": ["rollup"],
    "Vite": ["vite"],
    "Parcel": ["parcel"],
    "Babel": ["@babel/", "babel"],
    "ESLint": ["eslint"],
    "Prettier": ["prettier"],
    "TypeScript": ["typescript"],
}
TOOLING_GROUPS = [
    ("frameworks", FRAMEWORK_PATTERNS),
    ("testing_frameworks", TESTING_PATTERNS),
    ("build_tools", BUILD_TOOL_PATTERNS),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: technology groups over lower-cased file text
# ---------------------------------------------------------------------------
FRONTEND_PATTERNS: dict[str, list[str]] = {
    "React": ["react", "jsx"],
    "Vue.js": ["vue"],
    "Angular": ["angular", "@angular"],
    "Svelte": ["svelte"],
    "jQuery": ["jquery"],
    "Bootstrap": ["bootstrap"],
    "Tailwind CSS": ["tailwind"],
    "Material-UI": ["material-ui", "@mui"],
    "Styled Components": ["styled-components"],
}
BACKEND_PATTERNS: dict[str, list[str]] = {
    "Express.js": ["express"],
    "Django": ["django"],
    "Flask": ["flask"],
    "FastAPI": ["fastapi"],
    "Spring Boot": ["spring-boot", "springframework"],
    "Rails": ["rails"],
    "Laravel": ["laravel"],
    "ASP.NET": ["asp.net", "aspnet"],
}
DATABASE_PATTERNS: dict[str, list[str]] = {
    "PostgreSQL": ["postgresql", "postgres", "psycopg"],
    "MySQL": ["mysql"],
    "MongoDB": ["mongodb", "mongoose"],
    "Redis": ["redis"],
    "SQLite": ["sqlite"],
    "Elasticsearch": ["elasticsearch"],
    "Cassandra": ["cassandra"],
    "DynamoDB": ["dynamodb"],
}
CLOUD_PATTERNS: dict[str, list[str]] = {
    "AWS": ["aws", "boto3", "lambda", "s3", "ec2"],
    "Google Cloud": ["gcp", "google-cloud"],
    "Azure": ["azure", "microsoft"],
    "Heroku": ["heroku"],
    "Vercel": ["vercel"],
    "Netlify": ["netlify"],
    "Docker": ["docker", "dockerfile"],
    "Kubernetes": ["kubernetes", "k8s"],
}
MOBILE_PATTERNS: dict[str, list[str]] = {
    "React Native": ["react-native"],
    "Flutter": ["flutter", "dart"],
    "Ionic": ["ionic"],
    "Xamarin": ["xamarin"],
    "Cordova": ["cordova"],
    "Swift": ["swift"],
    "Kotlin": ["kotlin"],
}
TECHNOLOGY_GROUPS = [
    ("frontend_technologies", FRONTEND_PATTERNS),
    ("backend_technologies", BACKEND_PATTERNS),
    ("database_technologies", DATABASE_PATTERNS),
    ("cloud_services", CLOUD_PATTERNS),
    ("mobile_technologies", MOBILE_PATTERNS),
]

# API type: first matching rule wins, in this order.
API_TYPE_RULES = [
    ("GraphQL", ["graphql"]),
    ("REST API", ["rest", "api", "endpoint", "router"]),
    ("gRPC", ["grpc"]),
    ("WebSocket API", ["websocket"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: project type rules (in order)
# ---------------------------------------------------------------------------
FRONTEND_MARKERS = ["react", "vue", "angular"]
BACKEND_MARKERS = ["express", "koa", "fastify"]
PYTHON_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py"]
PYTHON_WEB_RULES = [
    ("django", "Django Web Application"),
    ("flask", "Flask Web Application"),
    ("fastapi", "FastAPI Application"),
]
MOBILE_MANIFESTS = ["pubspec.yaml", "android", "ios"]
JAVA_MANIFESTS = ["pom.xml", "build.gradle"]
SINGLE_MANIFEST_TYPES = [
    ("Cargo.toml", "Rust Application"),
    ("go.mod", "Go Application"),
    ("Gemfile", "Ruby Application"),
    ("composer.json", "PHP Application"),
]
CONTAINER_FILES = ["Dockerfile", "docker-compose.yml"]
DOC_SITE_SUFFIXES = [".md", ".rst"]
DOC_SITE_CODE_SUFFIXES = [".py", ".js", ".java"]
DOC_SITE_MAX_CODE_FILES = 5

# ---------------------------------------------------------------------------
# FIXED VALUES: architecture rules (immediate parent directory names)
# ---------------------------------------------------------------------------
ARCHITECTURE_DIR_RULES = [
    ("MVC (Model-View-Controller)", ["models", "views", "controllers"]),
    ("Microservices", ["services", "microservices"]),
    ("Clean Architecture", ["domain", "infrastructure", "application", "adapters"]),
    ("Component-Based Architecture", ["components", "containers"]),
]
MICROSERVICES_FILE = "docker-compose.yml"
API_FIRST_FILES = ["openapi.yaml", "swagger.yaml", "api.yaml"]
EVENT_WORDS = ["event", "queue", "pubsub", "kafka"]

# ---------------------------------------------------------------------------
# FIXED VALUES: clone flow vocabulary (20 code extensions)
# ---------------------------------------------------------------------------
CODE_EXTENSIONS: dict[str, str] = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "React JSX",
    ".tsx": "React TypeScript",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".php": "PHP",
    ".rb": "Ruby",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".sql": "SQL",
    ".sh": "Shell Script",
    ".bash": "Bash Script",
    ".ps1": "PowerShell",
}
# compared against the lower-cased file name, so the last three never match
COLLECT_EXTRA_NAMES = [
    "package.json", "requirements.txt", "pyproject.toml", "pom.xml",
    "Dockerfile", "Makefile", "README.md",
]
MAX_FILES_FOR_ANALYSIS = 15
BASIC_CONFIG_MARKERS = ["package.json", "requirements.txt", "pyproject.toml", "pom.xml", "setup.py"]
BASIC_DOC_MARKERS = ["readme", "changelog", "license", "contributing"]
BASIC_BUILD_MARKERS = ["Dockerfile", "Makefile"]
BASIC_MANAGERS = [("pip", "requirements.txt"), ("npm", "package.json"), ("maven", "pom.xml")]

# ---------------------------------------------------------------------------
# FIXED VALUES: key-file classes (first match wins) and quotas
# ---------------------------------------------------------------------------
KEY_MAIN_NAMES = ["main.py", "app.py", "index.js", "server.js", "main.go", "main.java"]
KEY_CONFIG_NAMES = ["settings.py", "config.js", "webpack.config.js", "next.config.js"]
KEY_CORE_WORDS = ["app", "core", "engine", "service", "manager"]
KEY_API_WORDS = ["api", "route", "controller", "handler"]
KEY_QUOTAS = [("main", 2), ("config", 2), ("core", 3), ("api", 3)]
KEY_EXTRA_SUFFIXES = [".py", ".js", ".ts", ".java", ".go"]
KEY_EXTRA_COUNT = 5
KEY_EXTRA_TARGET_LINES = 100

# ---------------------------------------------------------------------------
# FIXED VALUES: selection score for explanation (select_for_analysis)
# ---------------------------------------------------------------------------
SEL_FOCUS = 1000
SEL_MAIN_NAMES = ["main.py", "index.js", "app.py", "server.js", "main.go", "main.java"]
SEL_MAIN = 500
SEL_CORE_WORDS = ["app", "application", "core", "engine", "service"]
SEL_CORE = 300
SEL_CONFIG_NAMES = ["settings.py", "config.js", "webpack.config.js", "babel.config.js"]
SEL_CONFIG = 200
SEL_UTIL_WORDS = ["util", "helper"]
SEL_UTIL = 150
SEL_API_WORDS = ["api", "route", "endpoint", "controller"]
SEL_API = 250
SEL_MODEL_WORDS = ["model", "schema", "entity"]
SEL_MODEL = 200
SEL_TEST_WORDS = ["test", "spec"]
SEL_TEST = 100
SEL_CODE_EXT = 100
# lines 20..200 -> +50, 201..500 -> +25, over 500 -> -25
SEL_SIZE_BANDS = [(20, 200, 50), (201, 500, 25)]
SEL_SIZE_LARGE = -25
SEL_KEYWORDS = [
    "class ", "function ", "def ", "async ", "await",
    "interface", "abstract", "extends", "implements",
]
SEL_KEYWORD = 75
SEL_ROOT = 100
SELECTION_SHOWN = 10

# ---------------------------------------------------------------------------
# FIXED VALUES: report file order (importance 1..5)
# ---------------------------------------------------------------------------
ORDER_MAIN_NAMES = ["main.py", "app.py", "index.js", "server.js"]
ORDER_CONFIG_NAMES = ["settings.py", "config.js", "webpack.config.js"]
ORDER_CORE_WORDS = ["app", "core", "engine"]
ORDER_API_WORDS = ["api", "route", "controller"]

# ---------------------------------------------------------------------------
# FIXED VALUES: explanation replies and insights
# ---------------------------------------------------------------------------
EXPLANATION_DEFAULTS = {
    "summary": "No summary provided",
    "main_functionality": "No functionality description provided",
    "complexity_assessment": "Unknown",
}
FALLBACK_SUMMARY = "Analysis provided"
FALLBACK_SUMMARY_CUT = 200
FALLBACK_FUNCTIONALITY_CUT = 500
FAILED_EXPLANATION = {
    "summary": "Analysis failed due to an error",
    "main_functionality": "Could not determine",
    "complexity_assessment": "Unknown",
}
LIST_FIELDS = ["key_components", "dependencies", "improvement_suggestions", "code_patterns"]
IMPROVEMENT_THEMES = [
    ("Testing", ["test"]),
    ("Error Handling", ["error", "exception"]),
    ("Performance", ["performance"]),
    ("Documentation", ["documentation", "comment"]),
]
IMPROVEMENT_CATEGORIES = [
    ("Testing", ["test", "testing", "unit test", "integration test"]),
    ("Error Handling", ["error", "exception", "try", "catch", "handling"]),
    ("Performance", ["performance", "optimize", "speed", "memory", "cache"]),
    ("Documentation", ["document", "comment", "docstring", "readme"]),
    ("Security", ["security", "secure", "authentication", "authorization", "validation"]),
    ("Code Quality", ["refactor", "clean", "maintainability", "readability"]),
    ("Architecture", ["architecture", "design", "pattern", "structure"]),
]
IMPROVEMENT_OTHER = "Other"
COMMON_PATTERNS_N = 5
KEY_TECHNOLOGIES_N = 10
DEPENDENCY_USAGE_N = 10
PATTERN_USAGE_N = 8
USAGE_FILES_SHOWN = 3
ISSUE_THEME_PREFIX = "Investigate: "
ISSUE_TITLE_MAX = 120
ISSUE_TITLE_CUT = 117
ISSUE_LABELS = ["technical-debt", "automated"]
ISSUE_BODY_HEAD = "Found by the automated code analysis:\n\n"
ISSUE_BODY_TAIL = "\n\nSee generated report at: "
ISSUE_REPORT_NAME = "TechnicalDocument.md"

# ---------------------------------------------------------------------------
# FIXED VALUES: report sections
# ---------------------------------------------------------------------------
PROGRESS_WIDTH = 20
TOP_LANGUAGE_BYTES = 5
TOP_DIRECTORIES = 10
TOP_LARGEST = 10
LARGEST_SHOWN = 5
PROD_DEPS_SHOWN = 10
DEV_DEPS_SHOWN = 5
DOC_TIERS = [(0, "Poor"), (3, "Basic"), (8, "Good")]  # below bound -> tier; else Excellent
DOC_TIER_TOP = "Excellent"
DOC_GROUPS = [
    ("README Files", ["readme"]),
    ("API Documentation", ["api", "reference"]),
    ("Changelog", ["changelog"]),
    ("License", ["license"]),
    ("Contributing Guidelines", ["contributing", "contribute"]),
]
CI_MARKERS = [".github/workflows", "travis", "circle", "jenkins", "azure-pipelines"]
BUILD_FILES_SHOWN = 5
DEP_MANIFEST_MARKERS = ["package.json", "requirements.txt", "pom.xml", "cargo.toml"]
RECOMMENDATIONS = {
    "docs": "📚 **Improve Documentation:** Consider adding more documentation files such as API documentation, contributing guidelines, and detailed README sections.",
    "tests": "🧪 **Increase Test Coverage:** The project has minimal test files. Consider implementing comprehensive unit and integration tests.",
    "large": "🔧 **Refactor Large Files:** {n} files are over 500 lines. Consider breaking them into smaller, more manageable modules.",
    "nesting": "🎯 **Reduce Complexity:** {n} files have deep nesting. Consider refactoring to improve readability and maintainability.",
    "architecture": "🏗️ **Define Architecture:** Consider implementing clear architectural patterns to improve code organization and maintainability.",
    "ci": "⚙️ **Setup CI/CD:** Implement continuous integration and deployment pipelines to automate testing and deployment.",
    "deps": "📦 **Dependency Management:** Add proper dependency management files to ensure reproducible builds.",
    "ai_testing": "🧪 **AI-Identified Testing Improvements:** ",
    "ai_error": "⚠️ **AI-Identified Error Handling:** ",
    "ai_performance": "🚀 **AI-Identified Performance Optimizations:** ",
    "none": "✨ **Great Job!** The repository appears to be well-structured and follows good practices.",
}
TEST_RATIO_MIN = 0.1
AI_ERROR_WORDS = ["error", "exception", "handling"]
TOP_QUICK_LANGUAGES = 3
RECENT_COMMITS = 10
SHA_CHARS = 8

# ---------------------------------------------------------------------------
# The default prompt; {language}, {file_path}, {language_lower} and {content}
# are filled per file. The reply's field names are fixed values.
# ---------------------------------------------------------------------------
PROMPT_TEMPLATE = """
Explain this {language} file, `{file_path}`, to a developer who has never seen it.

```{language_lower}
{content}
```

Answer with one JSON object and nothing else. Its fields:

{
    "summary": "two or three sentences: what the file is for",
    "main_functionality": "what it does, step by step, and why",
    "key_components": ["a class, function or block, and its part in the whole"],
    "dependencies": ["a library, service or module that it needs"],
    "complexity_assessment": "Simple, Moderate, Complex or Very Complex, then the reason",
    "improvement_suggestions": ["a change worth making, and what it would gain"],
    "code_patterns": ["a design or coding pattern that it follows"]
}

Say what happens rather than what the syntax is, name the algorithms and the decisions behind them,
and mention what could go wrong.
"""
