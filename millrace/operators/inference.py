"""Skills inferred from what sections tell, by rules in buckets of confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import W

# The weight of a section, and the order in which equal scores settle.
SECTION_WEIGHTS = {"skills": 1.00, "experience": 1.00, "projects": 0.95, "education": 0.75, "misc": 0.60}
# The confidence of a bucket. A match of bucket neg silences the skill in its section.
BUCKETS = {"explicit": 1.00, "strong": 0.90, "weak": 0.70, "neg": 0.0}
# For each skill the words of its buckets, as parts of a regular expression of whole words.
RULES = {
    "git": {"explicit": "git|github|gitlab|bitbucket", "strong": "pull requests?|merge requests?|branch(?:ing)?|commit|github actions?|gitlab ci", "weak": "version control|code review|collaborative project", "neg": "svn|tfs"},
    "java": {"explicit": "java", "strong": r"spring(?: boot)?|maven|gradle|jpa|servlet|tomcat|junit|jvm|\.java|android", "weak": "oop|enterprise java|jakarta ee"},
    "python": {"explicit": "python", "strong": r"django|flask|fastapi|pandas|numpy|scikit-learn|tensorflow|pytorch|jupyter|pip|conda|\.py", "weak": "scripting|automation|data analysis|machine learning"},
    "javascript": {"explicit": "javascript|js|ecmascript", "strong": r"react|angular|vue|node\.?js|express|jquery|typescript|es6|es2015", "weak": "frontend|front-end|web development|client-side"},
    "react": {"explicit": r"react|reactjs|react\.js", "strong": r"jsx|redux|hooks|component|react native|next\.js", "weak": "frontend|ui|user interface"},
    "sql": {"explicit": "sql|mysql|postgresql|postgres|sqlite|oracle|mssql", "strong": "database|db|query|table|join|select|insert|update|delete", "weak": "data storage|data management|relational"},
    "docker": {"explicit": "docker", "strong": "container|containerization|dockerfile|docker compose|kubernetes|k8s", "weak": "devops|deployment|microservices"},
    "aws": {"explicit": "aws|amazon web services", "strong": "ec2|s3|lambda|rds|cloudformation|iam|vpc|route53", "weak": "cloud|cloud computing|infrastructure"},
    "kubernetes": {"explicit": "kubernetes|k8s", "strong": "pod|deployment|service|ingress|helm|minikube", "weak": "container orchestration|microservices"},
    "typescript": {"explicit": "typescript|ts", "strong": r"interface|type|generic|decorator|\.ts", "weak": "typed javascript|type safety"},
    "nodejs": {"explicit": r"node\.?js|nodejs", "strong": "express|npm|yarn|server-side|backend|api", "weak": "javascript runtime|server-side"},
    "mongodb": {"explicit": "mongodb|mongo", "strong": "document database|nosql|aggregation|mongoose", "weak": "database|data storage"},
    "redis": {"explicit": "redis", "strong": "cache|caching|in-memory|key-value", "weak": "database|data storage"},
    "ci/cd": {"explicit": "ci/cd|continuous integration|continuous deployment", "strong": "jenkins|github actions|gitlab ci|azure devops|travis|circleci", "weak": "automation|pipeline|deployment"},
    "microservices": {"explicit": "microservices|micro service", "strong": "api gateway|service mesh|distributed system|soa", "weak": "architecture|system design"},
    "api": {"explicit": "api|apis", "strong": "rest|graphql|soap|endpoint|http|json|xml", "weak": "integration|web service"},
    "linux": {"explicit": "linux|ubuntu|centos|debian|red hat", "strong": "bash|shell|terminal|command line|unix", "weak": "operating system|server"},
    "html": {"explicit": "html|html5", "strong": "semantic|accessibility|seo|markup", "weak": "web development|frontend"},
    "css": {"explicit": "css|css3", "strong": "flexbox|grid|sass|scss|bootstrap|tailwind", "weak": "styling|frontend|design"},
}


def pattern(words: str) -> str:
    """A regular expression of whole words for lower-case text; a word that starts with a full stop stands behind another."""
    behind = "|".join(w for w in words.split("|") if w.startswith(r"\."))
    plain = "|".join(w for w in words.split("|") if not w.startswith(r"\."))
    whole = rf"(?:^|[^{W}])(?:{plain})(?:$|[^{W}])"
    return rf"{whole}|[{W}](?:{behind})(?:$|[^{W}])" if behind else whole


def rules(table: dict = RULES) -> list[tuple[str, str, float, str]]:
    """(skill, bucket, confidence, pattern) of a table of rules."""
    return [(skill, bucket, BUCKETS[bucket], pattern(words)) for skill, buckets in table.items() for bucket, words in buckets.items()]


def inferred(sections: DataFrame, key: str, told: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(key, skill, section, bucket, score): for each skill its best rule match over a text's sections.

    sections: key, section, weight, ord, text. told: the rules. A match of bucket neg in a section silences the skill there. The score is
    confidence times weight, at most 1; of equal scores the first section holds. The rules are expressions of one narrow pass, so
    that nothing is joined or broadcast; then one aggregation by (key, skill) over the few hits.
    """
    by_skill: dict[str, list[tuple[str, float, str]]] = {}
    for skill, bucket, confidence, regex in told:
        by_skill.setdefault(skill, []).append((bucket, confidence, regex))
    text, hits = F.lower("text"), []
    for skill, buckets in by_skill.items():
        best = F.lit(None).cast("struct<skill:string,bucket:string,confidence:double>")
        for bucket, confidence, regex in sorted(buckets, key=lambda b: b[1]):  # a higher confidence wins; neg is tried first of all
            if bucket != "neg":
                best = F.when(text.rlike(regex), F.struct(F.lit(skill).alias("skill"), F.lit(bucket).alias("bucket"), F.lit(confidence).alias("confidence"))).otherwise(best)
        for bucket, _, regex in buckets:
            best = F.when(text.rlike(regex), None).otherwise(best) if bucket == "neg" else best
        hits.append(best)
    live = sections.select(key, "section", "weight", "ord", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    scored = live.select(key, "section", "ord", "h.skill", "h.bucket", F.round(F.least(F.lit(1.0), F.col("h.confidence") * F.col("weight")), 6).alias("score"))
    return scored.groupBy(key, "skill").agg(F.max_by(F.struct("section", "bucket", "score"), F.struct("score", -F.col("ord"))).alias("m")).select(key, "skill", "m.section", "m.bucket", "m.score")
