"""What log records say beyond usage: links between sessions, approvals, tool calls, lifecycle actions, and their shapes.

Nothing of a text leaves these functions but hashes and known categories. Input: ``parse_records`` rows that aren't bad.
Payloads nest as they like: ``walk`` follows them in the JVM, level by level, each record within its own row.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.sources.telemetry import _get

#: Fixed values of the format: words by which a path belongs to a session, and, for each reading of a payload, the depth and
#: the list length up to which it goes. What lies beyond is no part of the format; ``beyond`` counts it.
DOMAIN = ("session", "thread", "conversation", "rollout", "parent", "subagent", "agent")
LEAVES, KEYS, CALLS, ARGUMENTS = (7, 64), (4, 32), (9, 256), (8, 256)
#: Keys under which texts lie; they are never entered in search of calls.
NOISY = (
    "message", "messages", "prompt", "prompts", "content", "text", "body", "instructions", "stdout", "stderr", "output_text", "response", "responses",
    "last_agent_message", "formatted_output", "aggregated_output",
)

NODE = "array<struct<path:string,key:string,node:variant>>"


def fingerprint(value: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of an identifier; null for what can't be one (short, long, a path, prose)."""
    text = F.trim(value)
    ok = F.length(text).between(6, 256) & ~text.rlike(r"[/\\\n\r]") & (F.size(F.split(text, r"\s+")) <= 2)
    return F.when(ok, F.substring(F.sha2(text, 256), 1, 24))


def kind_of(node: Column) -> Column:
    """object, array, string, number, boolean or null."""
    name = F.schema_of_variant(node)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null").otherwise("number")
    )


def _members(node: Column, width: int) -> Column:
    """The members of an object, and the first ``width`` of a list, as (key in lower case or [], node)."""
    members = F.try_variant_get(node, "$", "map<string,variant>")
    items = F.slice(F.try_variant_get(node, "$", "array<variant>"), 1, width)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("node"))
    name = F.schema_of_variant(node)
    return F.when(name.startswith("OBJECT"), F.transform(F.map_entries(members), lambda m: entry(F.lower(m["key"]), m["value"]))).when(
        name.startswith("ARRAY"), F.transform(items, lambda v: entry(F.lit("[]"), v))
    ).otherwise(F.array().cast("array<struct<key:string,node:variant>>"))


def walk(df: DataFrame, root: Column, depth: int, width: int, enters: Callable[[Column], Column], name: str) -> DataFrame:
    """``df`` with the array ``name`` of all nodes (path, key, node) below ``root``, itself (empty path) first, to ``depth``
    levels. ``enters`` tells of a node (path, key, node) whether its members are looked at. One column a level, so that
    each is made once; no shuffle, no Python."""
    levels = [f"_{name}_{i}" for i in range(depth + 1)]
    none = F.array().cast(NODE)
    start = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("key"), root.alias("node")))
    d = df.withColumn(levels[0], F.when(root.isNotNull(), start).otherwise(none))
    for above, level in zip(levels, levels[1:]):

        def below(n: Column) -> Column:
            at = F.when(n["path"] == "", "").otherwise(F.concat(n["path"], F.lit(".")))
            return F.transform(_members(n["node"], width), lambda m: F.struct(F.concat(at, m["key"]).alias("path"), m["key"].alias("key"), m["node"].alias("node")))

        d = d.withColumn(level, F.flatten(F.transform(F.filter(above, enters), below)))
    return d.withColumn(name, F.concat(*levels)).drop(*levels)


def _good(records: DataFrame, *more: Column) -> DataFrame:
    at = F.unix_micros(F.try_to_timestamp(_get("$.timestamp", "string"))).alias("us")
    return records.where("not bad").select("source", "line", at, *more)


def payload_nodes(records: DataFrame, depth: int, width: int) -> DataFrame:
    """(source, line, us, type, nodes): the nodes of each record's payload, and what the record is called."""
    kind = F.lower(F.trim(F.coalesce(F.nullif(_get("$.payload.type", "string"), F.lit("")), _get("$.type", "string"), F.lit(""))))
    d = _good(records, _get("$.payload", "variant").alias("_payload"), kind.alias("type"))
    return walk(d, F.col("_payload"), depth, width, lambda n: F.lit(True), "nodes").drop("_payload")


def payload_leaves(records: DataFrame) -> DataFrame:
    """(source, line, path, kind, fp): each scalar of a record's payload by its path in lower case, with its JSON kind and
    its fingerprint (null where it can't be an identifier)."""
    n = payload_nodes(records, *LEAVES).select("source", "line", F.explode("nodes").alias("n")).where("n.path <> ''")
    d = n.select("source", "line", "n.path", kind_of(F.col("n.node")).alias("kind"), F.try_variant_get("n.node", "$", "string").alias("_text"))
    fp = F.when(F.col("kind").isin("string", "number"), fingerprint(F.col("_text")))
    return d.where(~F.col("kind").isin("object", "array")).select("source", "line", "path", "kind", fp.alias("fp"))


def beyond(records: DataFrame) -> DataFrame:
    """(deeper, longer): records whose payload holds more levels or longer lists than the format's readings go to."""
    depth, width = LEAVES
    n = payload_nodes(records, depth + 1, width + 1).select(F.col("nodes"))
    deep = F.exists("nodes", lambda x: F.size(F.split(x["path"], r"\.")) > depth)
    wide = F.exists("nodes", lambda x: F.size(F.try_variant_get(x["node"], "$", "array<variant>")) > width)
    return n.agg(F.count_if(deep).alias("deeper"), F.count_if(wide).alias("longer"))


def read_counts(records: DataFrame) -> DataFrame:
    """(source, duplicates, parse_errors) of ``parse_records``: usage records whose cumulative counts repeat the last ones
    known in their file, and lines that aren't JSON objects."""
    from meterline.operators import clean
    from meterline.sources.telemetry import usage_records

    totals = ["total_input", "total_cached", "total_output"]
    u = usage_records(records.where("not bad")).where("has_last")
    u = u.withColumns({c: F.when(F.col("has_total"), F.coalesce(c, F.lit(0))) for c in totals}).select("source", "line", *totals)
    kept = clean.drop_repeated_cumulative(u, totals).groupBy("source").agg(F.count("*").alias("kept"))
    n = u.groupBy("source").agg(F.count("*").alias("n")).join(kept, "source", "left").select("source", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("duplicates"))
    bad = records.groupBy("source").agg(F.count_if("bad").alias("parse_errors"))
    return bad.join(n, "source", "left").select("source", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), "parse_errors")


def link_ids(leaves: DataFrame) -> DataFrame:
    """(source, fp, is_parent, path): the identifiers of sessions that a file states, its own and its parents'; which paths
    say so is kept, so the count by path shows a changed format."""
    last, named = F.substring_index("path", ".", -1), F.col("path").rlike("|".join(DOMAIN))
    idish = last.endswith("_id") | last.isin("session", "thread", "conversation", "rollout") | (last == "id")
    parent = F.col("path").contains("parent") | F.col("path").contains("source.subagent")
    short = F.array_join(F.slice(F.split("path", r"\."), F.greatest(-F.size(F.split("path", r"\.")), F.lit(-5)), 5), ".")
    return leaves.where(idish & named & F.col("fp").isNotNull()).select("source", "fp", parent.alias("is_parent"), short.alias("path")).distinct()


def approval_markers(records: DataFrame) -> DataFrame:
    """(source, us, kind): records that are about an approval by their type or key names alone, whatever those keys hold: a
    request, a decision, or just an approval. The policy and reviewer settings are state, not markers; equal markers count
    once."""
    depth, width = KEYS
    d = payload_nodes(records, depth + 1, width).withColumn("keys", F.filter(F.transform("nodes", lambda n: n["key"]), lambda k: ~k.isin("", "[]")))
    says = lambda *w: F.col("type").rlike("|".join(w)) | F.exists("keys", lambda k: k.rlike("|".join(w)))
    own = F.exists("keys", lambda k: k.contains("approval") & ~k.isin("approval_policy", "approvals_reviewer"))
    d = d.where(~F.col("type").contains("thread_settings") & (F.col("type").contains("approval") | own) & F.col("us").isNotNull())
    kind = F.when(says("request", "prompt", "ask"), "request").when(says("decision", "response", "approved", "denied", "reject", "accept"), "decision").otherwise("approval")
    return d.select("source", "us", kind.alias("kind")).distinct()


#: The names under which lifecycle tools are called.
ACTIONS = {
    "spawn": ("spawn_agent", "spawn_subagent", "create_agent", "create_subagent"), "send": ("send_input", "send_message", "message_agent", "follow_up", "followup", "followup_task"),
    "resume": ("resume_agent", "resume_subagent"), "wait": ("wait_agent", "wait_for_agent", "poll_agent", "wait"), "close": ("close_agent", "terminate_agent", "stop_agent"), "interrupt": ("interrupt_agent",),
}
#: Keys whose values name an agent that a call addresses, and keys that name its role.
TARGETS = ("agent_id", "agent_ids", "subagent_id", "subagent_ids", "recipient_id", "recipient_ids", "target_id", "target_ids", "agent", "recipient", "target")
ROLE_KEYS = ("agent_type", "agent_role", "role", "task_name")


def _of(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{path}", kind)


def _texts(node: Column, *paths: str) -> Column:
    """The first of the members that is a text."""
    return F.coalesce(*(F.when(F.schema_of_variant(_of(node, p, "variant")) == "STRING", _of(node, p, "string")) for p in paths))


def parsed_text(value: Column) -> Column:
    """A text that holds an object or a list as that; any other value as it is."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
    return F.coalesce(F.when(text.rlike(r"^[\[{]"), F.try_parse_json(text)), value)


def _call_args(node: Column) -> Column:
    given = [_of(node, p, "variant") for p in ("arguments", "args", "input", "function.arguments")]
    return F.coalesce(*(F.when(~F.is_variant_null(g), g) for g in given))


def _is_call(node: Column) -> Column:
    return F.coalesce(_texts(node, "name", "tool_name", "function.name"), F.lit("")) != ""


def tool_calls(records: DataFrame) -> DataFrame:
    """(source, line, us, call_id, name, args, place): the calls anywhere in each record's payload; ``name`` in lower case
    without a prefix, ``args`` as variant (arguments come as an object or as its text), ``place`` its path. Outputs and
    results are no calls and are not entered, nor are texts, nor a call's own arguments."""
    depth, width = CALLS
    output = lambda n: F.coalesce(_of(n, "type", "string"), F.lit("")).rlike("(_output|_result)$")
    called = lambda n: _is_call(n) & _call_args(n).isNotNull()
    enters = lambda n: ~n["key"].isin(*NOISY) & ~F.coalesce(output(n["node"]), F.lit(False)) & ~F.coalesce(called(n["node"]), F.lit(False))
    d = _good(records, _get("$.payload", "variant").alias("_payload"))
    d = walk(d, F.col("_payload"), depth, width, enters, "nodes")
    calls = F.filter("nodes", lambda n: ~n["key"].isin(*NOISY) & called(n["node"]) & ~F.coalesce(output(n["node"]), F.lit(False)))
    d = d.select("source", "line", "us", F.explode(calls).alias("n")).withColumn("node", F.col("n.node"))
    low = F.substring_index(F.replace(F.lower(F.trim(_texts(F.col("node"), "name", "tool_name", "function.name"))), F.lit("-"), F.lit("_")), ".", -1)
    return d.select("source", "line", "us", _of(F.col("node"), "call_id", "string").alias("call_id"), low.alias("name"), parsed_text(_call_args(F.col("node"))).alias("args"), F.col("n.path").alias("place"))


def _arg(path: str, kind: str) -> Column:
    return F.try_variant_get("args", f"$.{path}", kind)


def _argument_nodes(calls: DataFrame) -> DataFrame:
    """``calls`` with ``given``: the nodes of their arguments outside of texts."""
    return walk(calls, F.col("args"), *ARGUMENTS, lambda n: ~n["key"].isin(*NOISY), "given")


def _values(node: Column) -> Column:
    """A scalar as a list of one text, a list of scalars as texts; nothing else."""
    many = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))
    one = F.when(~kind_of(node).isin("object", "array"), F.array(F.try_variant_get(node, "$", "string")))
    return F.coalesce(one, many, F.array().cast("array<string>"))


def lifecycle_actions(calls: DataFrame, roles: list[str] = ()) -> DataFrame:
    """Calls that start, address or end other agents: kind, call id, fingerprints of the targets anywhere in their arguments,
    and those of ``roles`` that a role argument names."""
    names = F.create_map(*(F.lit(x) for kind, own in ACTIONS.items() for n in own for x in (n, kind)))
    d = _argument_nodes(calls.withColumn("kind", names[F.col("name")]).where("kind is not null"))
    under = lambda n: n["key"].isin("id", "ids") & F.regexp_replace(n["path"], r"\.?[^.]*$", "").rlike("agent|recipient|target")
    targets = F.filter("given", lambda n: n["key"].isin(*TARGETS) | under(n))
    ids = F.array_compact(F.transform(F.flatten(F.transform(targets, lambda n: _values(n["node"]))), fingerprint))
    named = F.filter("given", lambda n: n["key"].isin(*ROLE_KEYS) & (F.schema_of_variant(n["node"]) == "STRING"))
    said = F.lower(F.array_join(F.transform(named, lambda n: F.try_variant_get(n["node"], "$", "string")), "\n"))
    hints = F.array_compact(F.array(*(F.when(said.rlike(f"(?<![a-z0-9]){r}(?![a-z0-9])"), r) for r in roles))) if roles else F.array().cast("array<string>")
    return d.select("source", "line", "us", "call_id", "kind", F.array_sort(F.array_distinct(ids)).alias("targets"), hints.alias("roles"), "place")


#: Fixed values of the format: parts of a tool's name, and the first word of a shell command, that tell what it does; the
#: first that fits counts.
READ_NAMES = ("read_file", "read_text", "open_file", "file_read", "view_file", "cat_file")
SEARCH_NAMES = ("search", "grep", "ripgrep", "find_files", "file_search")
WRITE_NAMES = ("apply_patch", "write_file", "edit_file", "replace_file", "patch")
TEST_NAMES = ("test", "pytest", "build", "compile", "lint", "check")
SHELL_NAMES = ("shell_command", "exec_command", "run_command", "terminal", "bash", "shell", "command")
COMMANDS = {
    "git-state": ("git",), "search": ("rg", "grep", "egrep", "fgrep", "find", "fd", "locate"), "file-read": ("cat", "head", "tail", "less", "more"),
    "test-build": ("pytest", "go", "make", "cmake", "ninja", "mvn", "gradle"),
}
#: Keys whose values are paths, and endings that make a word a path.
PATHS = ("path", "paths", "file", "files", "filepath", "file_path", "filename", "directory", "dir", "root", "cwd", "workdir", "working_directory", "target_path", "source_path")
SUFFIXES = (
    "py", "pyi", "rs", "go", "js", "jsx", "ts", "tsx", "java", "kt", "kts", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "bash", "zsh", "fish", "md", "txt",
    "json", "jsonl", "yaml", "yml", "toml", "ini", "cfg", "xml", "html", "css", "scss", "sql", "proto", "lock", "csv",
)


def shell_words(command: Column) -> Column:
    """The words of a shell command: quotes and backslashes as in POSIX shells; parted by white space alone where quotes
    don't close."""
    quoted = r"""'[^']*'|"(?:[^"\\]|\\[\s\S])*"|\\[\s\S]|[^\s'"\\]"""
    words = F.regexp_extract_all(command, F.lit(f"(?:{quoted})+"), F.lit(0))
    closed = F.regexp_replace(command, f"(?:{quoted}|\\s)+", "") == ""
    part = lambda w: F.regexp_extract_all(w, F.lit(quoted), F.lit(0))
    inner = lambda p: F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r"""\\(["\\])""", "$1")
    plain = lambda p: F.when(p.startswith("'"), F.substring(p, F.lit(2), F.length(p) - 2)).when(p.startswith('"'), inner(p)).when(p.startswith("\\"), F.substring(p, F.lit(2), F.lit(1))).otherwise(p)
    whole = F.transform(words, lambda w: F.array_join(F.transform(part(w), plain), ""))
    return F.when(closed, whole).otherwise(F.filter(F.split(command, r"\s+"), lambda w: w != ""))


def tool_events(calls: DataFrame) -> DataFrame:
    """(source, line, us, call_id, category, resources): what each call does by its tool's name, or for a shell by its
    command's first word, and the hashes of the paths in its path arguments, at any depth, and command."""
    names = F.create_map(*(F.lit(x) for kind, own in ACTIONS.items() for n in own for x in (n, kind)))
    has = lambda own: reduce(lambda a, b: a | b, (F.col("name").contains(n) for n in own))
    said = [F.coalesce(F.array_join(F.slice(_arg(k, "array<string>"), 1, 64), " "), F.when(F.schema_of_variant(_arg(k, "variant")) == "STRING", _arg(k, "string"))) for k in ("command", "cmd", "script", "shell_command")]
    command = F.coalesce(*said, F.when(F.schema_of_variant("args") == "STRING", F.try_variant_get("args", "$", "string")), F.lit(""))
    d = _argument_nodes(calls).withColumn("_words", shell_words(command))
    words = F.transform(F.slice("_words", 1, 8), F.lower)
    exe, more = F.regexp_extract(F.coalesce(F.get(words, F.lit(0)), F.lit("")), r"[^/]*$", 0), F.array_join(F.slice(words, 1, 4), " ")
    shell = F.col("name").isin(*SHELL_NAMES) | has(("shell", "exec"))
    label = F.when(names[F.col("name")].isNotNull(), "lifecycle").when(F.col("name") == "exec", "opaque-wrapper").when(has(READ_NAMES), "file-read")
    label = label.when((F.col("name") == "rg") | has(SEARCH_NAMES), "search").when(has(WRITE_NAMES), "write-edit").when(F.col("name").contains("git"), "git-state").when(has(TEST_NAMES), "test-build")
    for own, commands in COMMANDS.items():
        label = label.when(shell & exe.isin(*commands), own)
    label = label.when(shell & exe.isin("sed", "awk") & ~F.arrays_overlap(words, F.array(F.lit("-i"), F.lit("--in-place"))), "file-read")
    label = label.when(shell & (exe == "cargo") & F.coalesce(F.get(words, F.lit(1)).isin("test", "check", "build", "clippy"), F.lit(True)), "test-build")
    label = label.when(shell & exe.isin("npm", "pnpm", "yarn") & more.rlike("test|build|lint|check"), "test-build")
    label = label.when(shell & exe.isin("python", "python3", "node", "ruby") & more.rlike("test|lint|check"), "test-build").when(shell, "shell-other").otherwise("other")
    given = F.flatten(F.transform(F.filter("given", lambda n: n["key"].isin(*PATHS)), lambda n: _values(n["node"])))
    tokens = F.concat(given, F.when(shell, F.slice("_words", 1, 512)).otherwise(F.array().cast("array<string>")))
    edges = r"""['"`;,()\[\]{}]+"""
    bare = lambda t: F.regexp_replace(F.trim(t), f"^{edges}|{edges}$", "")
    unnumbered = lambda t: F.when(t.rlike(r"^[A-Za-z]:[\\/]"), t).otherwise(F.regexp_replace(t, r":\d+(:\d+)?$", ""))
    texts = F.filter(F.transform(tokens, bare), lambda t: F.length(t).between(1, 1024) & ~t.startswith("-") & ~t.contains("://"))
    ending = r"(?i)[^/\\.][^/\\]*\.({})$".format("|".join(SUFFIXES))
    pathish = lambda t: ~t.isin(".", "..", "/", "~") & (t.contains("/") | t.contains("\\") | t.startswith(".") | t.rlike(ending))
    paths = F.filter(F.transform(texts, unnumbered), pathish)
    hashes = F.transform(paths, lambda t: F.substring(F.sha2(F.replace(t, F.lit("\\"), F.lit("/")), 256), 1, 12))
    return d.select("source", "line", "us", "call_id", label.alias("category"), F.array_sort(F.array_distinct(hashes)).alias("resources"))


def action_schema(actions: DataFrame, leaves: DataFrame, spawned: DataFrame) -> DataFrame:
    """The shape of lifecycle calls by kind and path below the call: how often, in how many calls, of which JSON kinds, how
    many values could be identifiers, and how many of those are handles (fp) that spawns returned."""
    known = spawned.select("fp", F.lit(1).alias("_known")).distinct()
    own = actions.select("source", "line", F.col("kind").alias("action"), "place")
    d = leaves.withColumnRenamed("path", "_full").join(own, ["source", "line"])
    inside = (F.col("place") == "") | F.col("_full").startswith(F.concat("place", F.lit(".")))
    d = d.where(inside).withColumn("path", F.when(F.col("place") == "", F.col("_full")).otherwise(F.substring("_full", F.length("place") + 2, F.length("_full")))).join(known, "fp", "left")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), "+")
    return d.groupBy("action", "path").agg(F.count("*").alias("occurrences"), F.count_distinct("source", "line", "place").alias("calls"), kinds.alias("kinds"), F.count("fp").alias("id_shaped"), F.count("_known").alias("spawn_handles"))
