"""Values of stack detection, architecture, knowledge graph, scores and diligence."""

from __future__ import annotations

# Manifest file name -> package manager, build tool, and words of its lower-cased text with their frameworks.
MANIFESTS = [
    ("package.json", "npm", None, [("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("express", "Express")]),
    ("composer.json", "Composer", None, [("laravel/framework", "Laravel"), ("symfony/", "Symfony")]),
    ("pnpm-lock.yaml", "pnpm", None, []), ("yarn.lock", "yarn", None, []),
    ("requirements.txt", "pip/uv", None, [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask")]),
    ("pyproject.toml", "pip/uv", None, [("fastapi", "FastAPI"), ("django", "Django"), ("flask", "Flask")]),
    ("pom.xml", "Maven", "Maven", [("spring-boot", "Spring"), ("springframework", "Spring")]),
    ("build.gradle", "Gradle", "Gradle", [("spring-boot", "Spring"), ("springframework", "Spring"), ("ktor", "Ktor")]),
    ("build.gradle.kts", "Gradle", "Gradle", [("spring-boot", "Spring"), ("springframework", "Spring"), ("ktor", "Ktor")]),
    ("go.mod", "Go modules", None, [("github.com/gin-gonic/gin", "Gin"), ("github.com/go-chi/chi", "Chi"), ("github.com/gofiber/fiber", "Fiber"), ("github.com/labstack/echo", "Echo")]),
    ("Cargo.toml", "Cargo", None, [("actix-web", "Actix Web"), ("axum", "Axum"), ("rocket", "Rocket")]),
    ("*.csproj", "NuGet", ".NET", [("microsoft.aspnetcore", "ASP.NET Core"), ("sdk.web", "ASP.NET Core")]),
    ("*.sln", "NuGet", ".NET", [("microsoft.aspnetcore", "ASP.NET Core"), ("sdk.web", "ASP.NET Core")]),
    ("Dockerfile", None, "Docker", []), ("docker-compose.yml", None, "Docker", []), ("docker-compose.yaml", None, "Docker", []),
]
#: Manifests that count wherever they lie; of the others only the text of the one at the root does.
NESTED_MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts", "*.csproj", "*.sln")

# Roles and styles.
COMPONENT_ROLES = [
    ("API surface", ("api", "route", "router", "view", "controller")), ("Data access", ("db", "database", "model", "schema", "migration")), ("Tests", ("test", "spec")),
    ("User interface", ("frontend", "component", "app", "page")), ("Security/authentication", ("security", "auth", "login")), ("Documentation", ("docs", "readme")),
]
ROUTE_FILES = ("route", "routing", "router", "controller", "handler", "endpoint", "server")
DATA_FILES = ("database", "db", "repository", "storage", "migration")
CLUSTERS = [
    ("Auth", ("auth", "login", "session", "jwt", "token", "user")), ("API", ("api", "route", "router", "controller", "endpoint", "main.py")),
    ("Database", ("db", "database", "model", "schema", "migration", "store")), ("Security", ("security", "secret", "csrf", "cors", "permission")),
    ("Payments", ("payment", "billing", "stripe", "checkout", "invoice")), ("Infrastructure", ("docker", "deploy", "ci", ".github", "terraform", "k8s")),
    ("Frontend", ("frontend", "component", "page", "view", "ui", "react", "next")),
]
#: team -> bus factor, confidence
TEAMS = {"Security Platform": (2, 0.78), "Data Platform": (2, 0.72), "Product Experience": (3, 0.68), "Infrastructure": (2, 0.7), "Core Engineering": (1, 0.55)}
SEVERITY_SCORES = {"critical": 95, "high": 78, "medium": 55, "low": 25}
PATH_RISK = {"critical": 35, "high": 25, "medium": 14, "low": 6}
GRAPH_RELATIONS = ("CALLS", "IMPORTS", "DEPENDS_ON", "OWNS", "USES", "EXPOSES", "AFFECTS", "CONTAINS", "LINKED_TO")
RECRUITER_WEIGHTS = {"code": 0.35, "docs": 0.20, "tests": 0.20, "debt": 0.25}
INTEGRATIONS = ("url", "api", "stripe", "s3", "slack", "github")
DEPENDENCY_INTEGRATIONS = ("stripe", "slack", "aws", "s3", "github")
