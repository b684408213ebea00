"""Tables used to classify and expand question texts."""

# ---- fixed values (must stay as they are for results to be comparable) ----

INTENTS = [
    "architecture", "implementation", "functionality", "debugging", "usage", "relationship",
]

INTENT_KEYWORDS = {
    "architecture": [
        "architecture", "design", "pattern", "structure", "overview", "system",
        "components", "modules", "organization", "layout", "framework", "scalability",
        "maintainability", "performance", "reliability", "security", "modularity"],
    "implementation": [
        "implement", "implementation", "code", "function", "method", "class",
        "algorithm", "logic", "how does", "works", "written"],
    "functionality": [
        "what", "purpose", "does", "functionality", "feature", "capability",
        "behavior", "action", "operation", "task"],
    "debugging": [
        "error", "bug", "issue", "problem", "fix", "debug", "troubleshoot",
        "exception", "fail", "broken", "wrong"],
    "usage": [
        "how to", "usage", "use", "example", "tutorial", "guide", "help",
        "documentation", "api", "interface"],
    "relationship": [
        "relationship", "connect", "related", "dependency", "depends", "calls",
        "uses", "inherits", "extends", "imports", "references"],
}

INTENT_PATTERNS = {
    "architecture": [
        r"\b(architecture|design|structure|overview|system)\b",
        r"\b(components?|modules?|organization)\b",
        r"\bhow\s+is\s+.+\s+(structured|organized|designed)\b",
        r"\bwhat\s+is\s+the\s+(architecture|design|structure)\b"],
    "implementation": [
        r"\b(implement|implementation|algorithm|logic)\b",
        r"\bhow\s+(does|is)\s+.+\s+(implemented|coded|written)\b",
        r"\bshow\s+me\s+the\s+(code|implementation)\b",
        r"\b(function|method|class)\s+.+\s+(works|implementation)\b"],
    "functionality": [
        r"\bwhat\s+(does|is)\s+.+\s+(do|for)\b",
        r"\b(purpose|functionality|feature|capability)\b",
        r"\bwhat\s+is\s+the\s+(purpose|function)\s+of\b",
        r"\b(behavior|action|operation|task)\b"],
    "debugging": [
        r"\b(error|bug|issue|problem|fix|debug)\b",
        r"\b(exception|fail|broken|wrong)\b",
        r"\bwhy\s+(is|does)\s+.+\s+(not\s+work|fail|error)\b",
        r"\bhow\s+to\s+(fix|debug|solve)\b"],
    "usage": [
        r"\bhow\s+to\s+(use|call|invoke)\b",
        r"\b(usage|example|tutorial|guide|help)\b",
        r"\b(api|interface|documentation)\b",
        r"\bshow\s+me\s+(how|example|usage)\b"],
    "relationship": [
        r"\b(relationship|connect|related|dependency)\b",
        r"\b(depends|calls|uses|inherits|extends)\b",
        r"\bhow\s+(does|is)\s+.+\s+(connected|related)\b",
        r"\bwhat\s+(calls|uses|depends)\s+on\b"],
}

PATTERN_WEIGHT = 2
INTENT_FULL_SCORE = 5.0
DEFAULT_INTENT = ("search", 0.5)

INTENT_PHRASES = {
    "architecture": [
        "system architecture", "design patterns", "component structure",
        "module organization", "framework design"],
    "implementation": [
        "code implementation", "algorithm logic", "function method",
        "programming solution", "technical implementation"],
    "functionality": [
        "functionality purpose", "feature capability", "behavior operation",
        "what does this do", "code function"],
    "debugging": [
        "error handling", "bug fix", "troubleshooting", "exception handling",
        "debugging solution", "problem resolution"],
    "usage": [
        "usage example", "how to use", "api interface", "documentation",
        "tutorial guide", "code example"],
    "relationship": [
        "component relationship", "dependency connection", "code interaction",
        "module communication", "system integration"],
}

PROJECT_PHRASES = [
    "codebase indexing", "code search", "semantic search",
    "vector embeddings", "graph relationships",
]

FUNCTION_PATTERNS = [
    r"\b([a-z_][a-z0-9_]*)\s*\(",
    r"\bfunction\s+([a-z_][a-z0-9_]*)\b",
    r"\bdef\s+([a-z_][a-z0-9_]*)\b",
]
CLASS_PATTERNS = [
    r"\bclass\s+([A-Z][a-zA-Z0-9_]*)\b",
    r"\b([A-Z][a-zA-Z0-9_]*)\s+class\b",
]
FILE_PATTERNS = [
    r"\b([a-z_][a-z0-9_]*\.py)\b",
    r"\b([a-z_][a-z0-9_]*\.js)\b",
    r"\b([a-z_][a-z0-9_]*\.ts)\b",
]
VARIABLE_PATTERN = r"\b([a-z][a-zA-Z0-9_]*)\b"

STOP_WORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "up", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "among", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "must",
    "can", "this", "that", "these", "those", "what", "which", "who",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "now",
]

ABSTRACT_WORDS = [
    "assessment", "analysis", "evaluation", "review", "overview",
    "scalability", "maintainability", "reliability", "security",
    "performance", "optimization", "quality", "best practices",
    "recommendations", "improvements", "architecture", "design",
    "patterns", "principles", "strategy", "approach",
]
TECHNICAL_WORDS = [
    "function", "class", "method", "variable", "import", "export",
    "api", "endpoint", "database", "query", "table", "index",
    "async", "await", "promise", "callback", "event", "listener",
]

# (words that trigger the group, terms it adds), in the order they are tried
EXPANSION_GROUPS = [
    (["scalability"], [
        "performance optimization", "concurrent processing", "async operations",
        "database connection pooling", "caching mechanisms", "load balancing",
        "batch processing", "memory management", "resource utilization"]),
    (["maintainability"], [
        "code organization", "modular design", "separation of concerns",
        "error handling", "logging", "configuration management",
        "documentation", "testing", "code quality", "refactoring"]),
    (["reliability"], [
        "error handling", "exception management", "retry mechanisms",
        "health checks", "monitoring", "graceful degradation",
        "fault tolerance", "backup strategies", "data validation"]),
    (["security"], [
        "authentication", "authorization", "input validation",
        "data encryption", "secure communication", "access control",
        "api security", "vulnerability management", "secure storage"]),
    (["performance"], [
        "optimization", "caching", "indexing", "query performance",
        "memory usage", "cpu utilization", "response time",
        "throughput", "bottlenecks", "profiling"]),
    (["assessment", "analysis", "evaluation", "review"], [
        "code quality", "architecture patterns", "design principles",
        "error handling", "performance metrics", "resource management",
        "configuration", "logging", "monitoring", "testing"]),
    (["scalability", "scale", "scaling"], [
        "async", "concurrent", "parallel", "threading", "multiprocessing",
        "connection pool", "cache", "optimization", "batch", "queue",
        "load balancing", "distributed", "clustering"]),
    (["maintainability", "maintenance", "maintain"], [
        "modular", "separation", "abstraction", "interface", "dependency injection",
        "configuration", "logging", "error handling", "documentation",
        "testing", "refactoring", "code organization"]),
    (["performance", "optimization", "efficiency"], [
        "cache", "index", "query optimization", "memory", "cpu",
        "profiling", "benchmark", "bottleneck", "latency", "throughput",
        "algorithm complexity", "data structure"]),
    (["reliability", "robust", "fault tolerance"], [
        "error handling", "exception", "retry", "circuit breaker",
        "health check", "monitoring", "graceful shutdown", "backup",
        "recovery", "validation", "defensive programming"]),
    (["security", "secure", "protection"], [
        "authentication", "authorization", "validation", "sanitization",
        "encryption", "hashing", "token", "session", "access control",
        "input validation", "sql injection", "xss protection"]),
]
ALWAYS_EXPAND = [
    "tree-sitter", "ast parsing", "code chunking", "embedding generation",
    "vector search", "graph relationships", "neo4j", "qdrant",
    "semantic search", "code analysis", "mcp server", "fastapi",
]

COMPLEXITY_ORDER = ["architectural", "complex", "moderate"]
COMPLEXITY_PATTERNS = {
    "architectural": [
        r"architecture", r"system design", r"overall structure",
        r"solution architecture", r"system overview", r"design patterns"],
    "complex": [
        r"review \w+", r"assessment of \w+", r"comprehensive \w+",
        r"evaluate \w+", r"audit \w+"],
    "moderate": [
        r"analyze \w+", r"compare \w+ and \w+", r"how to \w+",
        r"best practices for \w+", r"optimize \w+"],
}
COMPLEX_WORDS = ["architecture", "design", "refactor", "security", "performance", "comprehensive"]
MODERATE_WORDS = ["explain", "analyze", "compare", "review", "optimize"]
TECHNICAL_ENTITY_TYPES = ["technology", "framework", "database", "function", "class"]

PLAN_BASE_SECONDS = {"simple": 5.0, "moderate": 15.0, "complex": 30.0, "architectural": 45.0}
PLAN_ROLE_SECONDS = 8.0
PLAN_PARALLEL = 3.0
PLAN_STREAM_SECONDS = 20.0

PREFERRED_KINDS = {
    "architecture": ["class", "module"],
    "implementation": ["function", "method"],
    "functionality": ["function", "class", "method"],
}
INTENT_BOOST = {
    "architecture": (["class", "module"], 1.2),
    "implementation": (["function", "method"], 1.2),
    "functionality": (["function", "class", "method"], 1.1),
}
ENTITY_BOOST = 1.3
CONFIDENCE_KNEE = 0.7
CONFIDENCE_SLOPE = 0.5

PROJECT_TECHNOLOGIES = [
    ("Python", ["python", ".py", "requirements.txt", "setup.py"]),
    ("JavaScript/TypeScript", [".js", ".jsx", ".ts", ".tsx", "package.json"]),
    ("React", ["react", "node_modules"]),
    ("FastAPI", ["fastapi", "uvicorn"]),
]
DEFAULT_TECHNOLOGY = "General"
UNKNOWN_PROJECT = ("Unknown Project", "Project information not available")

MENTION_CLASS = r"\b([A-Z][a-zA-Z0-9_]*(?:Client|Server|Manager|Processor|Generator|Analyzer))\b"
MENTION_FUNCTION = r"\b([a-z_][a-z0-9_]*(?:_[a-z0-9_]+)*)\(\)"
RELATION_PATTERNS = [
    (r"(?i)(\w+)\s+(?:calls|invokes|uses)\s+(\w+)", "calls"),
    (r"(?i)(\w+)\s+(?:inherits from|extends)\s+(\w+)", "inherits"),
    (r"(?i)(\w+)\s+(?:connects to|communicates with)\s+(\w+)", "communicates_with"),
    (r"(?i)(\w+)\s+(?:depends on|relies on)\s+(\w+)", "depends_on"),
]
ADVICE_PATTERNS = [
    r"(?i)(?:consider|recommend|suggest|should|could|might want to)\s+([^.]+)",
    r"(?i)(?:to improve|for better|to enhance)\s+([^.]+)",
    r"(?i)(?:optimization|improvement):\s*([^.]+)",
]

SECTION_HEADERS = [
    "EXECUTIVE SUMMARY", "DETAILED ANALYSIS", "ANALYSIS", "KEY INSIGHTS",
    "RECOMMENDATIONS", "RISK ASSESSMENT", "CONFIDENCE",
    "FOCUS AREAS FOR IMMEDIATE ATTENTION", "FOCUS AREAS",
]
