"""Ordered path / content word lists that give a chunk its area, layer or category."""

# ---- fixed values (must stay as they are for results to be comparable) ----

AREA_PATH = [
    ("models", ["model", "entity", "schema", "dto"]),
    ("services", ["service", "business", "logic"]),
    ("controllers", ["controller", "handler", "endpoint", "route"]),
    ("views", ["view", "component", "template", "ui"]),
    ("utils", ["util", "helper", "tool"]),
    ("config", ["config", "setting", "env"]),
    ("tests", ["test", "spec"]),
    ("database", ["db", "database", "migration", "sql"]),
    ("auth", ["auth", "login", "security", "permission"]),
    ("api", ["api", "rest", "graphql"]),
    ("frontend", ["frontend", "client", "web", "react", "vue", "angular"]),
    ("backend", ["backend", "server", "src"]),
    ("infrastructure", ["docker", "deploy", "infra", "k8s", "terraform"]),
]
AREA_CONTENT = [
    ("models", ["class ", "def __init__", "model", "schema"]),
    ("services", ["service", "business", "process"]),
    ("controllers", ["@app.route", "@router", "fastapi", "flask"]),
    ("views", ["render", "template", "component"]),
]
AREA_ORDER = [name for name, _ in AREA_PATH] + ["other"]

COVERAGE_PATH = [
    ("models", ["model", "entity", "schema"]),
    ("services", ["service", "business"]),
    ("controllers", ["controller", "handler", "route"]),
    ("views", ["view", "component", "template"]),
    ("utils", ["util", "helper"]),
    ("config", ["config", "setting"]),
    ("tests", ["test", "spec"]),
    ("database", ["db", "database"]),
    ("auth", ["auth", "login", "security"]),
    ("api", ["api", "rest"]),
    ("frontend", ["frontend", "client", "web"]),
    ("backend", ["backend", "server"]),
]
COVERAGE_TERMS = {
    "models": "data model class entity schema structure",
    "services": "service business logic process function method",
    "controllers": "controller handler endpoint route API",
    "views": "view component template UI interface",
    "utils": "utility helper function tool common",
    "config": "configuration settings environment setup",
    "tests": "test testing spec unit integration",
    "database": "database query SQL migration schema",
    "auth": "authentication authorization security login",
    "api": "API REST endpoint interface service",
    "frontend": "frontend client UI component interface",
    "backend": "backend server service logic processing",
}
BROAD_SEARCHES = [
    "class function method implementation",
    "service business logic processing",
    "controller handler endpoint API",
    "model schema data structure",
    "configuration settings environment",
    "test testing unit integration",
    "database query SQL migration",
    "authentication security authorization",
    "utility helper common function",
    "component interface frontend backend",
]
AREA_NAMES = [
    (name, [name]) for name in (
        "models", "services", "controllers", "utils", "config", "tests",
        "database", "auth", "api", "frontend", "backend", "other")
]

LAYERS = [
    ("API Layer", ["controller", "api", "endpoint", "route"]),
    ("Business Logic Layer", ["service", "business", "logic"]),
    ("Data Model Layer", ["model", "entity", "schema"]),
    ("Data Access Layer", ["database", "repository", "dao", "client"]),
    ("Presentation Layer", ["frontend", "ui", "component", "view"]),
    ("Utility Layer", ["util", "helper", "common"]),
    ("Configuration Layer", ["config", "setting"]),
]
LAYER_DEFAULT = "Core Layer"
LAYERS_FIVE = [
    ("api", ["controller", "api", "route", "endpoint"]),
    ("business", ["service", "business", "logic", "manager"]),
    ("data", ["model", "entity", "repository", "dao", "database"]),
    ("utility", ["util", "helper", "common", "shared"]),
]
LAYERS_SUMMARY = [
    ("data_layer", ["model", "entity", "schema"]),
    ("business_layer", ["service", "business", "logic"]),
    ("api_layer", ["controller", "handler", "api", "route"]),
    ("presentation_layer", ["view", "component", "ui", "frontend"]),
    ("utility_layer", ["util", "helper", "common"]),
    ("config_layer", ["config", "setting", "env"]),
    ("test_layer", ["test", "spec"]),
]
LAYERS_FOUR = [
    ("API Layer", ["controller", "api"]),
    ("Business Layer", ["service", "business"]),
    ("Data Layer", ["model", "entity"]),
    ("Utility Layer", ["util", "helper"]),
]
LAYER_PATH_WORDS = ["controller", "service", "model", "database", "api", "client"]

CATEGORY_PATH = [
    ("data_access", ["repository", "dao", "database", "db", "storage", "store"]),
    ("business_logic", ["service", "business", "logic", "domain", "core"]),
    ("api_layer", ["api", "controller", "endpoint", "route", "handler"]),
    ("ui_layer", ["ui", "frontend", "component", "view", "page", "interface"]),
    ("infrastructure", ["config", "util", "helper", "common", "shared"]),
    ("data_processing", ["processor", "parser", "transformer", "converter"]),
    ("communication", ["client", "server", "gateway", "proxy"]),
    ("security", ["auth", "security", "permission", "access"]),
    ("monitoring", ["log", "monitor", "metric", "health", "diagnostic"]),
]
CATEGORY_CONTENT = [
    ("data_access", ["select", "insert", "update", "delete", "query", "connection",
                     "database", "table", "collection", "repository"]),
    ("api_layer", ["request", "response", "endpoint", "route", "handler",
                   "get", "post", "put", "delete", "api"]),
    ("business_logic", ["calculate", "process", "validate", "transform", "business",
                        "rule", "logic", "algorithm"]),
    ("ui_layer", ["render", "component", "props", "state", "event",
                  "click", "submit", "form", "button"]),
    ("data_processing", ["parse", "transform", "convert", "process", "extract",
                         "chunk", "embed", "index"]),
    ("communication", ["client", "server", "request", "response", "http",
                       "websocket", "grpc", "rest"]),
    ("security", ["authenticate", "authorize", "permission", "token",
                  "encrypt", "decrypt", "hash", "validate"]),
]
CATEGORY_IMPORT = [
    ("data_access", ["sqlite", "postgres", "mysql", "mongodb", "redis", "qdrant", "neo4j"]),
    ("api_layer", ["fastapi", "flask", "django", "express", "axios"]),
    ("ui_layer", ["react", "vue", "angular", "svelte", "jquery"]),
    ("data_processing", ["pandas", "numpy", "sklearn", "torch", "transformers"]),
    ("communication", ["requests", "httpx", "aiohttp", "websockets"]),
    ("security", ["jwt", "bcrypt", "cryptography", "oauth"]),
    ("infrastructure", ["logging", "config", "os", "sys", "pathlib"]),
]
CATEGORY_THRESHOLD = 0.3
CODE_SUFFIXES = [".py", ".js", ".ts"]
GENERIC_CATEGORY = [
    ("testing", ["test", "spec"]),
    ("configuration", ["config", "setting"]),
    ("utilities", ["util", "helper"]),
    ("data_models", ["model", "schema"]),
]
GENERIC_CODE, GENERIC_OTHER = "application_logic", "miscellaneous"

CATEGORY_PURPOSE = {
    "data_access": "Manages data storage and retrieval operations",
    "api_layer": "Handles API requests and responses",
    "business_logic": "Implements core business rules and logic",
    "ui_layer": "Manages user interface and interactions",
    "data_processing": "Processes and transforms data",
    "communication": "Handles inter-service communication",
    "security": "Manages authentication and authorization",
    "infrastructure": "Provides system infrastructure and utilities",
    "monitoring": "Handles logging, monitoring, and diagnostics",
}
PURPOSE_SUFFIX = [
    ("manager", " through management operations"),
    ("processor", " through data processing"),
    ("client", " through client-side operations"),
    ("server", " through server-side operations"),
]

FILE_BONUS = [
    (0.3, ["main", "app", "server", "client", "core"]),
    (0.2, ["api", "interface", "endpoint", "route"]),
    (0.15, ["config", "setup", "init"]),
    (0.1, ["model", "schema", "entity"]),
]
CONTEXT_WEIGHTS = {
    "parents": 0.9, "children": 0.8, "calls": 0.7, "called_by": 0.6,
    "imports": 0.8, "imported_by": 0.7, "siblings": 0.5, "architectural_context": 0.9,
}
CONTEXT_WEIGHT_OTHER = 0.3
ARCHITECTURAL_CONTEXTS = ["parents", "architectural_context", "imports"]
ARCHITECTURAL_STEP, ARCHITECTURAL_SHARE = 0.3, 0.2

KIND_IMPORTANCE = {"class": 1.0, "function": 0.8, "method": 0.7, "module": 0.9, "interface": 0.8}
KIND_IMPORTANCE_OTHER = 0.5
ENTRY_FILES = ["main", "app", "index", "server", "__init__"]
CORE_NAMES = ["manager", "processor", "handler", "controller", "service", "client", "server"]

CONTENT_GROUPS = [
    ("database", ["database", "db", "query", "select", "insert", "update"]),
    ("api", ["api", "endpoint", "route", "fastapi", "flask", "request", "response"]),
    ("authentication", ["auth", "login", "token", "jwt", "password"]),
    ("configuration", ["config", "settings", "environment", "env"]),
    ("error handling", ["try:", "except", "raise", "error", "exception"]),
    ("async operations", ["async", "await", "asyncio"]),
    ("data processing", ["process", "transform", "parse", "extract"]),
    ("validation", ["validate", "check", "verify", "assert"]),
]
CONTENT_DEFAULT = "core functionality"
CONSTRUCT_TAGS = [
    ("classes", ["class "]),
    ("functions", ["def ", "function "]),
    ("imports", ["import ", "from "]),
    ("async_code", ["async "]),
    ("error_handling", ["try:", "except"]),
    ("testing", ["test", "assert"]),
    ("database_operations", ["select", "insert", "update", "delete", "query"]),
    ("api_endpoints", ["@app.route", "@router", "fastapi", "flask", "request", "response"]),
]

NAME_PATTERNS = [
    ("Service Layer Pattern", "service"),
    ("Repository Pattern", "repository"),
    ("MVC Pattern", "controller"),
    ("Factory Pattern", "factory"),
]
OBJECT_PATTERN = "Object-Oriented Design"

# stage, label, categories that show it is present (already in flow order)
FLOW_STAGES = [
    ("data_input", "Input/Parse", ["data_processing", "data_access"]),
    ("data_processing", "Process/Transform", ["business_logic", "data_processing"]),
    ("business_execution", "Execute Logic", ["business_logic", "application_logic"]),
    ("data_storage", "Store/Persist", ["data_access", "infrastructure"]),
    ("api_handling", "Handle Requests", ["api_layer", "communication"]),
    ("data_output", "Output/Response", ["api_layer", "ui_layer"]),
]
STEP_VERBS = [
    (["parse", "extract", "read"], "📥 Parse/Extract data using {}() in {}"),
    (["process", "transform", "convert"], "⚙️ Process/Transform data with {}() in {}"),
    (["store", "save", "persist"], "💾 Store/Persist data via {}() in {}"),
    (["search", "find", "query"], "🔍 Search/Query data using {}() in {}"),
    (["handle", "manage", "control"], "🎛️ Handle/Manage operations with {}() in {}"),
    (["init", "setup", "configure"], "🔧 Initialize/Setup {}() in {}"),
    (["validate", "check", "verify"], "✅ Validate/Check data with {}() in {}"),
]
STEP_ASYNC = "⚡ Execute async operation {}() in {}"
STEP_DEFAULT = "🔧 Execute {}() functionality in {}"

EXCLUDED_DIRS = [
    "node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", ".venv", "env", ".env",
    "build", "dist", ".idea", ".vscode", ".pytest_cache", ".mypy_cache", ".tox",
    "coverage", ".coverage", "htmlcov", ".DS_Store", "Thumbs.db",
]
LANGUAGE_BY_SUFFIX = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
}
USAGE_BANDS = [
    (10, "High Usage (Core Component)"),
    (5, "Medium Usage (Important Component)"),
    (2, "Low Usage (Supporting Component)"),
]
USAGE_DEFAULT = "Minimal Usage (Utility Component)"
COMPLEXITY_BANDS = [(3.0, "Very High"), (2.0, "High"), (1.0, "Medium"), (0.5, "Low")]
COMPLEXITY_DEFAULT = "Very Low"
CONFIDENCE_BANDS = [
    (0.9, "Very High"), (0.8, "High"), (0.7, "Good"), (0.6, "Moderate"), (0.5, "Fair"),
]
CONFIDENCE_DEFAULT = "Low"
EDGE_KINDS = [("PARENT_OF", "CHILD_OF", 1.0), ("CALLS", "CALLED_BY", 0.5), ("IMPORTS", "IMPORTED_BY", 0.3)]
HYBRID_WEIGHTS = {"embedding": 0.4, "graph": 0.3, "centrality": 0.15, "path": 0.15, "entity": 0.2}
CALL_KEYWORDS = [
    "if", "for", "while", "switch", "catch", "return", "function", "def", "class",
    "elif", "and", "or", "not", "in", "with", "print",
]
