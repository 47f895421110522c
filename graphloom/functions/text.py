"""Column functions on paths, hashes, keywords and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "dart": "dart", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "sql": "sql", "graphql": "graphql", "gql": "graphql", "yaml": "yaml", "yml": "yaml", "json": "json", "dockerfile": "dockerfile",
}
#: Layers by path, first match wins.
LAYERS = (
    (r"(?i)/(migrations?|schema|models?|entities|prisma|drizzle|sequelize|typeorm|knex)/", "database"),
    (r"(?i)\.(sql|prisma)\z", "database"),
    (r"(?i)/(controllers?|services?|repositories?|handlers?|middleware|routes?|api)/", "backend"),
    (r"(?i)\.(php|rb|py)\z", "backend"),
    (r"(?i)\.(c|h|cpp|cc|cxx|hpp)\z", "backend"),
    (r"(?i)/(graphql|resolvers?)/", "api"),
    (r"\.(graphql|gql)\z", "api"),
    (r"(?i)/openapi\.|swagger\.", "api"),
    (r"(?i)/(components?|pages?|views?|screens?|layouts?|hooks?|contexts?|widgets?)/", "frontend"),
    (r"\.(jsx|tsx|html|htm|css|scss|sass)\z", "frontend"),
    (r"(?i)\.(dart|swift|kt|kts)\z", "frontend"),
    (r"(?i)/(lib/screens|lib/widgets|lib/pages|app/src/main/res)/", "frontend"),
    (r"(?i)/(config|configs?|settings?|environments?)/", "config"),
    (r"(?i)\.(env|ya?ml|toml|ini|dockerfile|json)\z", "config"),
    (r"(?i)/(docker|k8s|kubernetes|terraform|helm)/", "infrastructure"),
)
#: Text that tries to instruct a model.
INJECTIONS = (
    r"(?i)/\*\s*(AI|SYSTEM|ASSISTANT|HUMAN|USER)\s*:", r"(?i)<!--\s*(AI|SYSTEM|ASSISTANT|HUMAN|USER)\s*:", r"(?i)#\s*(AI|SYSTEM|ASSISTANT|HUMAN|USER)\s*:", r"(?i)//\s*(AI|SYSTEM|ASSISTANT)\s*:",
    r"(?i)IGNORE PREVIOUS INSTRUCTIONS", r"(?i)DISREGARD ALL PRIOR", r"(?i)\[INST\]", r"(?i)<\|im_start\|>",
)
#: Words that no keyword list holds, by profile, and the shortest keyword.
STOP_WORDS = {
    "search": ("the", "a", "an", "and", "or", "in", "on", "to", "for", "of", "with", "is", "fix", "add", "get", "set", "my", "all", "make", "any"),
    "plan": ("this", "that", "with", "from", "make", "change", "update", "refactor", "fix", "add", "remove"),
    "context": (
        "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
        "should", "may", "might", "shall", "can", "this", "that", "it", "make", "all", "fix", "any", "add", "get", "set", "from", "my", "i",
    ),
}
SHORTEST = {"search": 3, "plan": 4, "context": 3}
TEST_FILE = r"(?i)\.(spec|test)\.(ts|js|tsx|jsx)\z|__tests__|\btest(s)?\b"
GENERATED_FILE = r"(?i)\.generated\.|\.min\.|node_modules|dist/|\.d\.ts\z"
CODE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "cs", "c", "cpp")
IGNORED = ("node_modules", ".git", "dist", "coverage", "__pycache__", ".min.js")


def _extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def detect_language(path: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(F.lower(path).endswith("dockerfile"), "dockerfile").otherwise(F.coalesce(F.element_at(m, _extension(path)), F.lit("unknown")))


def detect_layer(path: Column, configured: dict[str, list[str]] | None = None) -> Column:
    """Configured path parts first, then the patterns in order, else backend."""
    out = F.lit("backend")
    for pattern, layer in reversed(LAYERS):
        out = F.when(path.rlike(pattern), layer).otherwise(out)
    for layer, parts in reversed(list((configured or {}).items())):
        for p in reversed(parts):
            out = F.when(path.contains(p), layer).otherwise(out)
    return out


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def content_hash(c: Column, kind: str) -> Column:
    """md5_12, sha256_16 or sha256."""
    return {"md5_12": F.substring(F.md5(c), 1, 12), "sha256_16": F.substring(F.sha2(c, 256), 1, 16), "sha256": F.sha2(c, 256)}[kind]


def scrub_injections(text: Column) -> tuple[Column, Column]:
    """The text with every instruction replaced, and how many there were."""
    n = F.lit(0)
    for p in INJECTIONS:
        n = n + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, "[SCRUBBED]")
    return text, n.cast("long")


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_generated_file(path: Column) -> Column:
    return path.rlike(GENERATED_FILE)


def is_code_path(path: Column) -> Column:
    out = _extension(path).isin(*CODE_EXTENSIONS)
    for part in IGNORED:
        out = out & ~path.contains(part)
    return out


def grep(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """(path, line, text): lines that fit, case-insensitively, in order of path and line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    hit = lines.where(F.col("text").rlike(f"(?i){pattern}"))
    return hit.select("path", (F.col("n") + 1).cast("long").alias("line"), F.trim("text").alias("text")).orderBy("path", "line").limit(limit)


def chunk_text(nodes: DataFrame) -> DataFrame:
    """(id, chunk) of the kinds that are searched: kind and name, signature and comment if there are, path."""
    n = nodes.where(F.col("kind").isin("function", "class", "api_endpoint", "file"))
    extra = [F.col(c) for c in ("signature", "doc_comment") if c in nodes.columns]
    return n.select("id", F.concat_ws("\n", F.concat(F.lit("["), F.upper("kind"), F.lit("] "), "name"), *extra, F.concat(F.lit("Path: "), "file_path")).alias("chunk"))


def extract_keywords(text: Column, profile: str = "search") -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= SHORTEST[profile]) & ~w.isin(*STOP_WORDS[profile]))


def parse_model_output(text: Column) -> Column:
    """JSON text: the text itself, else its first fenced block that parses, else the outermost brackets without trailing commas."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & bare(c).rlike(r"^[\[{]"), bare(c))
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)```"), F.lit(1))
    block = F.element_at(F.filter(F.transform(fenced, lambda b: valid(b)), lambda b: b.isNotNull()), 1)
    block = F.when(F.exists(fenced, lambda b: valid(b).isNotNull()), block)
    span = F.regexp_replace(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), r",(\s*[\]}])", "$1")
    return F.coalesce(valid(text), block, valid(span))


#: Tools of an agent, and the argument that some must not leave empty.
TOOLS = ("read_file", "write_file", "patch_file", "delete_file", "move_file", "list_files", "run_shell", "search_code", "find_references", "pause_and_ask", "spawn_sub_agent", "finish")
NEEDED = {"write_file": "content", "patch_file": "diff", "finish": "summary"}


def validate_actions(rows: DataFrame) -> DataFrame:
    """(id, violation) of rows(id, action): action is JSON with tool, reasoning and args; null where it is valid.

    A path must be relative and never climb above the root.
    """
    a = F.from_json("action", "tool string, reasoning string, args map<string,string>")
    depth = F.aggregate(
        F.split(F.col("path"), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")),
        lambda s: s["low"],
    )
    missing = F.lit(None).cast("string")
    for tool, n in NEEDED.items():
        missing = F.when((F.col("a.tool") == tool) & (F.trim(F.coalesce(F.element_at("a.args", n), F.lit(""))) == ""), f"missing_{n}").otherwise(missing)
    v = (
        F.when(F.col("a.tool").isNull(), "not_json")
        .when(~F.col("a.tool").isin(*TOOLS), "unknown_tool")
        .when(F.coalesce(F.trim("a.reasoning"), F.lit("")) == "", "no_reasoning")
        .when(F.col("path").startswith("/"), "absolute_path")
        .when(depth < 0, "path_escape")
        .otherwise(missing)
    )
    return rows.select("id", a.alias("a")).withColumn("path", F.element_at("a.args", "path")).select("id", v.alias("violation"))


#: Parts of a lower-cased target that only a placeholder holds.
PLACEHOLDERS = ("absolute path", "file_path", "example.js")


def valid_tasks(tasks: DataFrame) -> DataFrame:
    """Rows of tasks(target_file, description, ...) with both texts, and a target that is a path and no placeholder."""
    target = F.coalesce("target_file", F.lit(""))
    holder = F.lit(False)
    for p in PLACEHOLDERS:
        holder = holder | F.lower(target).contains(p)
    return tasks.where((target != "") & (F.coalesce("description", F.lit("")) != "") & ~holder & target.rlike(r"[./\\]"))


def trim_payload(text: Column, most_tokens: int = 3500) -> Column:
    """Short texts as they are; long ones by their section marks, their lines, or their ends."""
    marks = F.regexp_count(text, F.lit(r"=== [^=\n]+ ==="))
    second, last = F.locate("===", text, 2), F.length(text) - F.locate("===", F.reverse(text)) - 1
    lines = F.split(text, "\n")
    gap = F.lit("\n...\n")
    by_lines = F.concat(F.array_join(F.slice(lines, 1, 100), "\n"), gap, F.array_join(F.slice(lines, F.greatest(F.size(lines) - 199, F.lit(1)), 200), "\n"))
    by_ends = F.concat(F.substring(text, 1, 1500), gap, F.substring(text, -12500, 12500))
    by_marks = F.concat(F.substring(text, F.lit(1), second + 300), gap, F.substring(text, F.greatest(last - 100, F.lit(1)), F.length(text)))
    return F.when(F.ceil(F.length(text) / 4) <= most_tokens, text).when(marks >= 3, by_marks).when(F.size(lines) > 400, by_lines).otherwise(by_ends)


def fit_conversations(messages: DataFrame, window: int, buffer: int = 2000) -> DataFrame:
    """Messages that fit 0.8 * window - buffer tokens: all, or the first, the last six, and the newest of the others.

    messages(conv_id, turn, tokens); turns are ordered by turn. No message is kept twice.
    """
    budget = 0.8 * window - buffer
    conv = Window.partitionBy("conv_id")
    m = messages.withColumn("i", F.row_number().over(conv.orderBy("turn"))).withColumn("back", F.row_number().over(conv.orderBy(F.desc("turn"))))
    m = m.withColumn("all", F.sum("tokens").over(conv)).withColumn("fixed", (F.col("i") == 1) | (F.col("back") <= 6))
    m = m.withColumn("base", F.coalesce(F.sum(F.when(F.col("fixed"), F.col("tokens"))).over(conv), F.lit(0.0)))
    upto = F.sum(F.when(~F.col("fixed"), F.col("tokens"))).over(conv.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("upto", F.col("base") + F.coalesce(upto, F.lit(0.0))).where((F.col("all") <= budget) | F.col("fixed") | (F.col("upto") < budget)).select(*messages.columns)


def needs_compression(messages: DataFrame, window: int) -> DataFrame:
    m = messages.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"))
    return m.select("conv_id", "tokens", (F.col("tokens") > 0.5 * window).alias("compress"))


def compression_steps(steps: DataFrame, every: int = 8, least: int = 2000) -> DataFrame:
    """(session_id, step): where a session is compressed, for steps(session_id, step, length of what may be compressed).

    That is the first step at least `every` after the last compression whose length is over `least`. Only the numbers of
    a session's long steps meet in one row.
    """
    long = steps.where(F.col("length") > least).groupBy("session_id").agg(F.array_sort(F.collect_set(F.col("step").cast("long"))).alias("s"))
    none = F.array().cast("array<long>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    taken = F.aggregate("s", none, lambda a, x: F.when(x - last(a) >= every, F.concat(a, F.array(x))).otherwise(a))
    return long.select("session_id", F.explode(taken).alias("step"))


def line_changes(pairs: DataFrame) -> DataFrame:
    """(id, line, change, n): lines that one side of pairs(id, old_content, new_content) holds more often, as bags."""
    side = lambda c, d: pairs.select("id", F.explode(F.split(F.coalesce(c, F.lit("")), "\n")).alias("line"), F.lit(d).alias("d"))
    n = side("old_content", -1).unionByName(side("new_content", 1)).groupBy("id", "line").agg(F.sum("d").alias("n")).where("n <> 0")
    return n.select("id", "line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("n"))


def line_diffs(pairs: DataFrame) -> DataFrame:
    """(id, old_pos, new_pos, line, state): kept, added, removed or moved lines of pairs(id, old_content, new_content).

    The k-th occurrence of a line on one side is paired with the k-th on the other; a pair is kept if no earlier old
    line went further down, else moved.
    """

    def side(c, name):
        s = pairs.select("id", F.posexplode(F.split(F.coalesce(c, F.lit("")), "\n")).alias(name, "line"))
        return s.withColumn("k", F.row_number().over(Window.partitionBy("id", "line").orderBy(name)))

    j = side("old_content", "old_pos").join(side("new_content", "new_pos"), ["id", "line", "k"], "full_outer")
    before = F.max("new_pos").over(Window.partitionBy("id").orderBy(F.asc_nulls_last("old_pos"), "new_pos").rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(F.col("old_pos").isNull(), "added").when(F.col("new_pos").isNull(), "removed").when(F.col("new_pos") < F.coalesce("before", F.lit(-1)), "moved").otherwise("kept")
    return j.withColumn("before", before).select("id", "old_pos", "new_pos", "line", state.alias("state"))


def diff_hunks(diffs: DataFrame, context: int = 3) -> DataFrame:
    """(id, hunk, start, end, added, removed): changed positions of line_diffs, joined where context lines would touch."""
    c = diffs.where("state <> 'kept'").select("id", F.coalesce("new_pos", "old_pos").alias("pos"), "state")
    at = Window.partitionBy("id").orderBy("pos", "state")
    c = c.withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(at), F.lit(1 << 30)) > 2 * context).cast("int"))
    c = c.withColumn("hunk", F.sum("new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("id", "hunk").agg(F.greatest(F.min("pos") - context, F.lit(0)).alias("start"), (F.max("pos") + context).alias("end"), F.count_if(F.col("state") == "added").alias("added"), F.count_if(F.col("state") == "removed").alias("removed"))


def diff_stats(diffs: DataFrame) -> DataFrame:
    """(id, additions, deletions, files) of unified diff texts diffs(id, diff)."""
    lines = F.split("diff", "\n")
    some = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return diffs.select("id", some(r"^\+(?!\+\+)").alias("additions"), some(r"^-(?!--)").alias("deletions"), some(r"^\+\+\+ ").alias("files"))
