"""Tables for rule-based entity extraction."""

# ---- fixed values (must stay as they are for results to be comparable) ----

_EXTENSIONS = "py|js|ts|jsx|tsx|java|cpp|c|h|go|rs|rb|php|swift|kt"

# entity type -> patterns; group 1 is the entity text, the whole match is the span
ENTITY_PATTERNS = [
    ("technology", [
        r"\b(Python|JavaScript|TypeScript|Java|C\+\+|C#|Go|Rust|Ruby|PHP|Swift|Kotlin|Scala|Clojure|Haskell|Erlang|Elixir)\b",
        r"\b(HTML|CSS|SQL|GraphQL|YAML|JSON|XML|Markdown)\b",
        r"\b(AWS|Azure|GCP|Google Cloud|DigitalOcean|Heroku|Vercel|Netlify)\b",
        r"\b(Docker|Kubernetes|Terraform|Ansible|Jenkins|GitLab CI|GitHub Actions)\b",
        r"\b(Nginx|Apache|HAProxy|Cloudflare|CDN)\b"]),
    ("framework", [
        r"\b(React|Vue|Angular|Svelte|Next\.js|Nuxt\.js|Gatsby)\b",
        r"\b(Django|Flask|FastAPI|Express|Koa|Nest\.js|Spring|Laravel|Rails|Phoenix)\b",
        r"\b(TensorFlow|PyTorch|Keras|Scikit-learn|Pandas|NumPy|Matplotlib)\b",
        r"\b(Bootstrap|Tailwind|Material-UI|Ant Design|Chakra UI)\b"]),
    ("database", [
        r"\b(PostgreSQL|MySQL|SQLite|MongoDB|Redis|Cassandra|DynamoDB|Neo4j|Qdrant|Elasticsearch|InfluxDB)\b",
        r"\b(Oracle|SQL Server|MariaDB|CouchDB|RethinkDB|ArangoDB)\b"]),
    ("function", [
        r"\b([a-z_][a-z0-9_]*)\s*\(",
        r"\bfunction\s+([a-z_][a-z0-9_]*)\b",
        r"\bdef\s+([a-z_][a-z0-9_]*)\b",
        r"\basync\s+def\s+([a-z_][a-z0-9_]*)\b",
        r"\b([a-z_][a-z0-9_]*)\s*=>\s*"]),
    ("class", [
        r"\bclass\s+([A-Z][a-zA-Z0-9_]*)\b",
        r"\b([A-Z][a-zA-Z0-9_]*)\s+class\b",
        r"\binterface\s+([A-Z][a-zA-Z0-9_]*)\b",
        r"\btype\s+([A-Z][a-zA-Z0-9_]*)\b"]),
    ("file", [
        rf"\b([a-z_][a-z0-9_]*\.({_EXTENSIONS}))\b",
        rf"\b([A-Z][a-zA-Z0-9_]*\.({_EXTENSIONS}))\b"]),
    ("variable", [
        r"\bvar\s+([a-z_][a-z0-9_]*)\b",
        r"\blet\s+([a-z_][a-z0-9_]*)\b",
        r"\bconst\s+([a-z_][a-z0-9_]*)\b",
        r"\b([A-Z_][A-Z0-9_]*)\b"]),
    ("api", [
        r"\b(REST|GraphQL|gRPC|WebSocket|HTTP|HTTPS|FTP|SMTP|TCP|UDP)\b",
        r"\b(API|endpoint|route|middleware|handler)\b"]),
    ("pattern", [
        r"\b(Singleton|Factory|Observer|Strategy|Command|Adapter|Decorator|Facade|Proxy|MVC|MVP|MVVM)\b",
        r"\b(Repository|Service|Controller|Model|View|Component|Module|Plugin)\b"]),
    ("concept", [
        r"\b(microservices|monolith|serverless|event-driven|message queue|pub-sub|CQRS|DDD)\b",
        r"\b(authentication|authorization|OAuth|JWT|session|cookie|CORS|CSRF)\b",
        r"\b(caching|load balancing|scaling|performance|optimization|monitoring|logging)\b"]),
]
# the one pattern that is only meaningful with case kept (upper-case constants)
CASE_SENSITIVE_PATTERN = r"\b([A-Z_][A-Z0-9_]*)\b"

PATTERN_CONFIDENCE = 0.7
DICTIONARY_CONFIDENCE = 0.9
ALIAS_CONFIDENCE = 0.8

COMPANIES = [
    "Apple", "Google", "Microsoft", "Amazon", "Meta", "Facebook", "Netflix", "Tesla",
    "OpenAI", "Anthropic", "Hugging Face", "GitHub", "GitLab", "Atlassian", "Slack",
    "Stripe", "Shopify", "Spotify", "Uber", "Airbnb", "Twitter", "LinkedIn", "Reddit",
]
PEOPLE = [
    "Linus Torvalds", "Tim Cook", "Elon Musk", "Jeff Bezos", "Mark Zuckerberg",
    "Satya Nadella", "Sundar Pichai", "Sam Altman", "Dario Amodei", "Yann LeCun",
]
ALIASES = [
    ("JS", "JavaScript"), ("TS", "TypeScript"), ("CSS3", "CSS"), ("HTML5", "HTML"),
    ("ES6", "JavaScript"), ("Node", "Node.js"), ("React Native", "React"),
    ("Vue.js", "Vue"), ("Angular.js", "Angular"),
]

SPECIFICITY = {
    "function": 10, "class": 10, "method": 9, "variable": 8, "file": 8,
    "technology": 7, "framework": 7, "database": 7, "company": 6, "person": 6,
    "concept": 5, "organization": 4,
}
TYPE_BONUS = {
    "function": 0.15, "class": 0.15, "method": 0.12, "technology": 0.10,
    "framework": 0.10, "database": 0.10, "file": 0.08, "variable": 0.05,
    "company": 0.08, "person": 0.05, "concept": 0.03,
}
REPEAT_STEP, REPEAT_CAP = 0.05, 0.2
CONTEXT_BONUS = 0.1
EARLY_SHARE, EARLY_BONUS = 0.2, 0.05

CONTEXT_KEYWORDS = {
    "function": ["method", "function", "call", "invoke", "execute", "run"],
    "class": ["class", "object", "instance", "inherit", "extend", "implement"],
    "database": ["query", "table", "schema", "connection", "transaction", "index"],
    "framework": ["library", "package", "dependency", "import", "install", "configure"],
    "api": ["endpoint", "request", "response", "HTTP", "REST", "GraphQL"],
}
