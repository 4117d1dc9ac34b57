"""Auditing agent repositories: files, tools, obligations, their links, contract rules, rubric and coverage.

Extraction from source code and prose runs over Arrow batches, as Python's
parser and match positions are needed; everything after it is relational.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell the side effect and risk of a tool, matched anywhere in its name and description.
DESTRUCTIVE = ["delete", "remove", "drop", "terminate", "revoke", "destroy", "purge", "wipe", "shutdown", "execute_shell", "run_command", "exec", "eval"]
EXTERNAL_WRITE = ["send", "post", "update", "write", "create", "transfer", "publish", "submit", "execute", "deploy", "forward", "invite", "tweet", "slack", "book", "purchase", "refund", "charge", "schedule"]
WEAK = ["log", "notify", "cache", "tag", "mark", "annotate", "create_draft", "save", "label", "archive", "mark_read", "update_local"]
FINANCIAL = ["refund", "charge", "payment", "transfer"]
#: Stop words of linking and, longer, of coverage.
LINK_STOPS = "the a an is are to for and of in on it that this with be as at or by from not".split()
COVERAGE_STOPS = "the a an is are to for and of in on it that this with be as at or by from not should must shall will can may do does did has have had was were been being if then else when where which who whom what how all each every both few more most other some such no nor only own same so than too very".split()
#: Patterns of obligations by type.
OBLIGATIONS: dict[str, list[str]] = {
    "CONFIRMATION_REQUIRED": [r"confirm(?:ation)?\s+before", r"ask\s.*user\s.*before", r"require[s]?\s.*approval", r"never\s.*without\s.*confirm", r"explicit\s.*confirmation", r"get\s.*confirmation", r"obtain\s.*confirmation", r"require[s]?\s.*confirmation"],
    "LOOKUP_REQUIRED": [r"look\s+up", r"retrieve\s.*before", r"check\s.*first", r"fetch\s.*before", r"check\s+the\s+database", r"check\s+CRM", r"verify\s+before\s+answering"],
    "POLICY_CHECK_REQUIRED": [r"check\s.*policy", r"verify\s.*eligibility", r"compliance\s.*check", r"consult\s+policy", r"according\s+to\s+policy", r"refund\s+policy"],
    "ERROR_REPORTING_REQUIRED": [r"report\s.*error", r"inform\s.*user\s.*fail", r"disclose\s.*error", r"if\s+the\s+tool\s+fails", r"if\s+an\s+error\s+occurs", r"do\s+not\s+claim\s+success", r"tell\s+the\s+user\s+it\s+failed"],
    "RETRIEVAL_INJECTION_GUARD": [r"untrusted", r"do\s+not\s+trust", r"do\s+not\s+follow\s.*instructions\s.*retrieved", r"treat\s.*retrieved\s.*as\s+data", r"documents\s+may\s+contain\s+malicious", r"retrieved\s+content\s+is\s+untrusted"],
    "FINAL_STATE_CONSISTENCY": [r"verify\s.*state", r"confirm\s.*result", r"ensure\s.*consistency", r"only\s+say\s+completed\s+if", r"verify\s+the\s+action\s+succeeded", r"do\s+not\s+claim\s+success\s+unless"],
}
ORDERING = r"(?i)\b(?:before|after|must precede|prior to|then)\b"
PRECONDITION = re.compile(r"\b(confirm|confirmed|approved|verified|permission|requires?\s+(?:confirmation|approval|verification|permission)|must\s+(?:confirm|approve|verify)|before\s+(?:sending|executing|deleting|removing))\b", re.I)
TOOL_NAME = re.compile(r"send_email$|delete_\w+|create_\w+|send_\w+")
#: Words of the rubric's questions.
RUBRIC: dict[str, list[str]] = {
    "decision": ["break down", "step by step", "plan", "decide"],
    "stop": ["max_iterations", "max_steps", "done", "complete", "finished", "stop_condition", "termination"],
    "selection": ["choose", "select", "pick", "route", "dispatch"],
    "multi_agent": ["agents=", "crew", "swarm", "supervisor", "worker", "delegate"],
    "delegation": ["delegate", "handoff", "transfer", "assign_to", "forward_to"],
    "shared_state": ["shared_memory", "blackboard", "message_queue"],
    "hitl": ["confirm", "approve", "permission", "human_review", "ask_user", "override", "escalate"],
    "override": ["override", "intervention", "manual", "escalate", "human_fallback"],
    "retry": ["retry", "backoff", "max_retries"],
    "timeout": ["timeout", "deadline"],
    "fallback": ["fallback", "default", "graceful"],
    "partial_completion": ["checkpoint", "resume", "recover", "rollback"],
    "recovery": ["recover", "rollback", "restore", "compensate", "cleanup"],
}
#: Categories of files in order of precedence are those of ``file_category``.
_IMPERATIVE = r"\bYou are\b|\bYou must\b|\bAlways\b|\bNever\b|\bDo not\b"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def side_effect(name: Column, description: Column) -> Column:
    """NONE, WEAK, EXTERNAL_WRITE or DESTRUCTIVE; a name that is a weak word is weak."""
    text = F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit(""))))
    return F.when(F.lower(name).isin(WEAK), "WEAK").when(_any(text, DESTRUCTIVE), "DESTRUCTIVE").when(_any(text, EXTERNAL_WRITE), "EXTERNAL_WRITE").when(_any(text, WEAK), "WEAK").otherwise("NONE")


def risk_level(name: Column, description: Column) -> Column:
    effect = side_effect(name, description)
    financial = _any(F.lower(F.concat_ws(" ", name, F.coalesce(description, F.lit("")))), FINANCIAL)
    return F.when(effect == "DESTRUCTIVE", "CRITICAL").when((effect == "EXTERNAL_WRITE") & financial, "CRITICAL").when(effect == "EXTERNAL_WRITE", "HIGH").when(effect == "WEAK", "MEDIUM").otherwise("LOW")


def file_categories(path: Column, content: Column) -> Column:
    """All categories a file fits, in order of precedence; UNKNOWN if none.  The first is its primary one."""
    p, text = F.lower(path), F.coalesce(content, F.lit(""))
    ext = F.regexp_extract(p, r"(\.[^./]+)$", 1)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    steps = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    body = F.ltrim(text)
    first = F.get_json_object(text, "$[0]")
    keyed = F.coalesce(F.get_json_object(text, "$.steps"), F.get_json_object(text, "$.tool_calls"), F.get_json_object(text, "$.messages[0].role"), F.get_json_object(first, "$.role"), F.get_json_object(first, "$.tool_call"), F.get_json_object(first, "$.tool_calls"))
    trace = (ext == ".jsonl") | ((ext == ".json") & steps & (body.startswith("{") | body.startswith("[")) & keyed.isNotNull())
    json_schema = (ext == ".json") & steps & F.coalesce(F.get_json_object(text, "$.functions[*].parameters"), F.get_json_object(text, "$.tools[*].input_schema")).isNotNull()
    yaml_schema = ext.isin(".yaml", ".yml") & ((F.contains(text, F.lit("functions:")) & F.contains(text, F.lit("parameters:"))) | (F.contains(text, F.lit("tools:")) & F.contains(text, F.lit("input_schema:"))))
    defined = text.rlike(r"@tool\b|@function_tool\b|@agent\.tool\b|def\s+send_email\b|def\s+delete_\w+|def\s+create_\w+|def\s+send_\w+")
    source = (ext == ".py") & (defined | (p.rlike(r"(?:^|/)tools/") & text.rlike(r"def\s+\w+\(")))
    checks = [
        ("TRACE", trace), ("TOOL_SCHEMA", json_schema | yaml_schema), ("TOOL_SOURCE", source),
        ("PROMPT", _any(p, ["prompt", "system", "instructions"]) | name.isin("agent.md", "agents.md", "claude.md") | text.rlike(_IMPERATIVE)),
        ("POLICY", _any(p, ["policy", "rules", "guardrail", "safety", "compliance"])), ("EVAL", _any(p, ["eval", "test_cases", "golden", "benchmark", "cases"])),
        ("CONFIG", ext.isin(".toml", ".cfg") | _any(p, ["config", "settings"])), ("DOC", name.startswith("readme") | ext.isin(".txt", ".rst", ".md")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return F.when(F.size(found) == 0, F.array(F.lit("UNKNOWN"))).otherwise(found)


def tokens(text: Column, stops: list[str]) -> Column:
    """Different lower-case runs of ASCII letters and digits without stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))
    return F.array_except(words, F.array(*map(F.lit, stops)))


def link(obligations: DataFrame, tools: DataFrame) -> DataFrame:
    """(obligation_id, tool, shared): obligations (obligation_id, source_text) and tools (name, description) with a token in common."""
    left = obligations.select("obligation_id", F.explode(tokens(F.col("source_text"), LINK_STOPS)).alias("token"))
    right = tools.select(F.col("name").alias("tool"), F.explode(tokens(F.concat_ws(" ", "name", "description"), LINK_STOPS)).alias("token"))
    return left.join(right, "token").groupBy("obligation_id", "tool").agg(F.count(F.lit(1)).alias("shared"))


def transitions(obligations: DataFrame, links: DataFrame) -> DataFrame:
    """(predecessor, successor, obligation_id) that the typed or ordering obligations forbid to skip."""
    kind = F.col("obligation_type")
    before = F.when(kind == "CONFIRMATION_REQUIRED", "user_confirmation").when(kind == "POLICY_CHECK_REQUIRED", "policy_check").when(kind == "LOOKUP_REQUIRED", "lookup").when(F.col("source_text").rlike(ORDERING), "ordering_check")
    return obligations.withColumn("predecessor", before).where("predecessor IS NOT NULL").join(links, "obligation_id").select("predecessor", F.col("tool").alias("successor"), "obligation_id")


def coverage(obligations: DataFrame, files: DataFrame) -> DataFrame:
    """(obligation_id, score, status, files): the best share of an obligation's tokens in one file, and the files with at least 0.3."""
    left = obligations.select("obligation_id", tokens(F.col("source_text"), COVERAGE_STOPS).alias("t")).withColumn("n", F.size("t"))
    right = files.select("path", F.explode(tokens(F.col("content"), COVERAGE_STOPS)).alias("token"))
    hits = left.select("obligation_id", "n", F.explode("t").alias("token")).join(right, "token").groupBy("obligation_id", "path", "n").agg(F.count(F.lit(1)).alias("k"))
    best = hits.withColumn("s", F.col("k") / F.col("n")).groupBy("obligation_id").agg(F.max("s").alias("score"), F.count_if(F.col("s") >= 0.3).alias("files"))
    out = obligations.select("obligation_id").join(best, "obligation_id", "left").na.fill(0, ["score", "files"])
    return out.withColumn("status", F.when(F.col("score") >= 0.6, "covered").when(F.col("score") >= 0.3, "partial").otherwise("missing"))


_PATTERNS = [(k, re.compile(p, re.I)) for k, ps in OBLIGATIONS.items() for p in ps]


def obligations_in(path: str | None, text: str | None) -> Iterator[tuple[str, str, str, str | None, int]]:
    """(obligation_id, obligation_type, source_text, path, at) of every match in one text."""
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text or ""):
            around = (text or "")[max(0, m.start() - 20) : m.end() + 40].strip()
            yield hashlib.sha256(f"{path}|{kind}|{m.start()}".encode()).hexdigest()[:12], kind, around, path, m.start()


def _extract_obligations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for r in obligations_in(path, text)]
        columns = list(zip(*rows)) if rows else [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.int64())], ["obligation_id", "obligation_type", "source_text", "path", "at"])


def extract_obligations(texts: DataFrame) -> DataFrame:
    """Every match of every obligation pattern in (path, text), with an id from path, type and place."""
    return texts.select(F.col("path").cast("string").alias("path"), "text").mapInArrow(_extract_obligations, "obligation_id string, obligation_type string, source_text string, path string, at bigint")


def _python_tools(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        marks = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
        marked = any((isinstance(d, ast.Name) and d.id in ("tool", "function_tool")) or (isinstance(d, ast.Attribute) and d.attr == "tool") for d in marks)
        if not marked and not TOOL_NAME.match(node.name):
            continue
        doc = ast.get_docstring(node) or ""
        arguments = [a for a in node.args.args if a.arg != "self"]
        optional = len(node.args.defaults)
        params = [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else "Any", "required": i < len(arguments) - optional} for i, a in enumerate(arguments)]
        out.append({"name": node.name, "description": doc, "return_type": ast.unparse(node.returns) if node.returns else "Any", "params": params})
    return out


def _schema_tools(text: str) -> list[dict]:
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return []
    listed = data if isinstance(data, list) else [*(data.get("functions") or []), *(data.get("tools") or [])] if isinstance(data, dict) else []
    out = []
    for item in listed:
        item = item.get("function", item) if isinstance(item, dict) else None
        schema = item and (item.get("parameters") or item.get("input_schema"))
        if not isinstance(schema, dict) or "name" not in item:
            continue
        required = schema.get("required") or []
        params = [{"name": k, "type": str(p.get("type", "Any")), "required": k in required} for k, p in (schema.get("properties") or {}).items() if isinstance(p, dict)]
        out.append({"name": str(item["name"]), "description": str(item.get("description", "")), "return_type": "Any", "params": params})
    return out


def tools_in(path: str | None, text: str | None) -> list[dict]:
    """The tools defined in one Python source or JSON schema."""
    name = path or ""
    return _python_tools(text or "") if name.endswith(".py") else _schema_tools(text or "") if name.endswith(".json") else []


_TOOL_SCHEMA = "path string, name string, description string, return_type string, parameters array<struct<name:string,type:string,required:boolean>>, preconditions array<string>"


def _extract_tools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    params = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("required", pa.bool_())]))
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            rows += [(path, t["name"], t["description"], t["return_type"], t["params"], [m.strip() for m in PRECONDITION.findall(t["description"])]) for t in tools_in(path, text)]
        c = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in c[:4]], pa.array(c[4], params), pa.array(c[5], pa.list_(pa.string()))], [f.split()[0] for f in _TOOL_SCHEMA.split(", ")])


def extract_tools(files: DataFrame) -> DataFrame:
    """Tools defined in Python sources and JSON schemas of (path, text); files that don't parse have none."""
    return files.select("path", "text").mapInArrow(_extract_tools, _TOOL_SCHEMA)


def contract_findings(tools: DataFrame, obligations: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, severity, subject) of the rules A to G and of safety that is only prompted.

    tools: name, side_effect, preconditions, all_optional (null without
    parameters); obligations: obligation_id, obligation_type; links:
    obligation_id, tool.  Existence questions are semi and anti joins.
    """
    typed = links.join(obligations, "obligation_id").select("obligation_id", "obligation_type", F.col("tool").alias("name"))
    dangerous = tools.where(F.col("side_effect").isin("DESTRUCTIVE", "EXTERNAL_WRITE"))
    kind = F.col("obligation_type")
    holds = lambda words: F.exists(F.coalesce("preconditions", F.array().cast("array<string>")), lambda p: _any(F.lower(p), words))

    def finding(df: DataFrame, rule: str, severity: Column, subject: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), severity.alias("severity"), subject.alias("subject"))

    high = F.lit("HIGH")
    a = finding(dangerous.join(typed, "name", "left_anti"), "A_no_obligation", F.when(F.col("side_effect") == "DESTRUCTIVE", "CRITICAL").otherwise("HIGH"), F.col("name"))
    b = finding(typed.where(kind == "CONFIRMATION_REQUIRED").join(tools, "name").where(~holds(["confirm", "approv", "permission"])), "B_unenforced_confirmation", high, F.concat_ws(":", "obligation_id", "name"))
    c = finding(tools.where(_any(F.lower("name"), FINANCIAL) & ~holds(["policy", "eligib", "verif", "check"])), "C_unchecked_money", high, F.col("name"))
    d = finding(tools.where("side_effect = 'DESTRUCTIVE'").join(typed.where(kind == "CONFIRMATION_REQUIRED"), "name", "left_anti"), "D_unconfirmed_destruction", F.lit("CRITICAL"), F.col("name"))
    retrieves = tools.where(_any(F.lower("name"), ["search", "retriev", "fetch", "query"])).agg((F.count(F.lit(1)) > 0).alias("r"))
    writes = dangerous.agg((F.count(F.lit(1)) > 0).alias("w"))
    guards = obligations.where(kind == "RETRIEVAL_INJECTION_GUARD").agg((F.count(F.lit(1)) == 0).alias("g"))
    e = finding(retrieves.crossJoin(F.broadcast(writes)).crossJoin(F.broadcast(guards)).where("r AND w AND g"), "E_no_injection_guard", high, F.lit("contract"))  # one row each
    verified = links.where(_any(F.lower("tool"), ["verify", "check", "validate"])).select("obligation_id")
    f = finding(obligations.where(kind == "FINAL_STATE_CONSISTENCY").join(verified, "obligation_id", "left_anti"), "F_unverified_state", high, F.col("obligation_id").cast("string"))
    g = finding(dangerous.where("all_optional"), "G_all_optional", high, F.col("name"))
    only = typed.where(~kind.isin("CONFIRMATION_REQUIRED", "FINAL_STATE_CONSISTENCY")).join(tools, "name").where(F.coalesce(F.size("preconditions"), F.lit(0)) == 0)
    p = finding(only, "prompt_only", F.lit("MEDIUM"), F.concat_ws(":", "obligation_id", "name"))
    out = a
    for part in (b, c, d, e, f, g, p):
        out = out.unionByName(part)
    return out


#: Who the agent is told to be; words that bound a delegation; severity of each gap.
IDENTITY = r"(?i)you are\b|your role is\b|your purpose is\b|you help\b"
BOUNDS = ["limit", "bound", "max", "scope", "depth"]
GAP_SEVERITY = {
    "AGENT_OVERVIEW_GAP": "MEDIUM", "DECISION_POLICY_GAP": "MEDIUM", "STOP_CONDITION_GAP": "MEDIUM", "TOOL_SELECTION_POLICY_GAP": "LOW", "ORCHESTRATION_UNSPECIFIED": "MEDIUM",
    "UNBOUNDED_DELEGATION": "HIGH", "SHARED_STATE_UNSPECIFIED": "MEDIUM", "HITL_GAP": "HIGH", "APPROVAL_ENFORCEMENT_GAP": "HIGH", "OVERRIDE_GAP": "MEDIUM",
    "RETRY_POLICY_GAP": "LOW", "TIMEOUT_POLICY_GAP": "LOW", "FALLBACK_POLICY_GAP": "LOW", "PARTIAL_COMPLETION_GAP": "LOW", "RECOVERY_STATE_GAP": "MEDIUM",
}


def rubric(texts: DataFrame, key: str, tools: DataFrame | None = None, obligations: DataFrame | None = None) -> DataFrame:
    """(key, gap, severity): the gaps that the texts (key, text), tools (key, side_effect) and obligations (key, obligation_type) of each key leave.

    Roles of several prompts are told apart by the least and greatest role
    named, so a key's texts are only aggregated.  A null key is a key.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    roles = F.regexp_extract_all(low, F.lit(r"you are (?:a |an )?(\w+)"), F.lit(1))
    r = texts.groupBy(key).agg(
        *[F.coalesce(F.bool_or(_any(low, w)), F.lit(False)).alias(q) for q, w in (RUBRIC | {"bounds": BOUNDS}).items()],
        F.coalesce(F.bool_or(F.coalesce("text", F.lit("")).rlike(IDENTITY)), F.lit(False)).alias("identity"),
        ((F.count(F.lit(1)) >= 2) & F.coalesce(F.max(F.array_max(roles)) != F.min(F.array_min(roles)), F.lit(False))).alias("roles"),
    )
    spark = texts.sparkSession
    kind = dict(texts.dtypes)[key]
    tools = tools if tools is not None else spark.createDataFrame([], f"{key} {kind}, side_effect string")
    obligations = obligations if obligations is not None else spark.createDataFrame([], f"{key} {kind}, obligation_type string")
    t = tools.groupBy(F.col(key).alias("_t")).agg(F.lit(True).alias("tools"), F.bool_or(F.col("side_effect").isin("DESTRUCTIVE", "EXTERNAL_WRITE")).alias("dangerous"))
    o = obligations.groupBy(F.col(key).alias("_o")).agg(F.bool_or(F.col("obligation_type") == "CONFIRMATION_REQUIRED").alias("confirmed"))
    r = r.join(t, F.col(key).eqNullSafe(F.col("_t")), "left").join(o, F.col(key).eqNullSafe(F.col("_o")), "left").na.fill(False, ["tools", "dangerous", "confirmed"])
    has = F.col
    multi = has("multi_agent") | has("roles")
    gaps = {
        "AGENT_OVERVIEW_GAP": ~has("identity"), "DECISION_POLICY_GAP": ~has("decision") & ~has("stop"), "STOP_CONDITION_GAP": has("decision") & ~has("stop"), "TOOL_SELECTION_POLICY_GAP": has("tools") & ~has("selection"),
        "ORCHESTRATION_UNSPECIFIED": multi & ~has("delegation") & ~has("shared_state"), "UNBOUNDED_DELEGATION": multi & has("delegation") & ~has("bounds"), "SHARED_STATE_UNSPECIFIED": multi & ~has("shared_state"),
        "HITL_GAP": has("dangerous") & ~has("hitl") & ~has("confirmed"), "APPROVAL_ENFORCEMENT_GAP": has("dangerous") & has("hitl") & ~has("confirmed"), "OVERRIDE_GAP": has("dangerous") & ~has("override"),
        "RETRY_POLICY_GAP": has("tools") & ~has("retry"), "TIMEOUT_POLICY_GAP": has("tools") & ~has("timeout"), "FALLBACK_POLICY_GAP": has("tools") & ~has("fallback"),
        "PARTIAL_COMPLETION_GAP": has("decision") & ~has("partial_completion"), "RECOVERY_STATE_GAP": has("dangerous") & ~has("recovery"),
    }
    cells = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(g).alias("gap"), F.lit(GAP_SEVERITY[g]).alias("severity"))) for g, c in gaps.items()]))
    return r.select(key, F.explode(cells).alias("x")).select(key, "x.*")


def coverage_findings(covered: DataFrame, obligations: DataFrame) -> DataFrame:
    """(finding_type, severity, subject) of the obligations that no test covers: (obligation_id, status) of ``coverage``."""
    grave = F.col("obligation_type").isin("CONFIRMATION_REQUIRED", "RETRIEVAL_INJECTION_GUARD")
    missing = covered.where("status = 'missing'").join(obligations.select("obligation_id", "obligation_type"), "obligation_id")
    return missing.select(F.lit("COVERAGE_GAP").alias("finding_type"), F.when(grave, "CRITICAL").otherwise("HIGH").alias("severity"), F.col("obligation_id").cast("string").alias("subject"))


#: Names of variables and functions that hold prompts in Python sources.
PROMPT_VARIABLE = re.compile(r"(?:[A-Z0-9_]*_)?(?:PROMPT|INSTRUCTIONS)$|SYSTEM_PROMPT$")
PROMPT_FUNCTION = re.compile(r"prompt|system", re.I)
PROMPT_KEYS = ("system", "prompt", "instructions", "system_prompt", "content")


def _python_prompts(text: str) -> list[tuple[str, str]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            out += [(t.id, node.value.value) for t in node.targets if isinstance(t, ast.Name) and PROMPT_VARIABLE.match(t.id)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and PROMPT_FUNCTION.search(node.name):
            out.append((node.name, ast.get_docstring(node) or ""))
    return out


def _json_prompts(text: str) -> list[tuple[str, str]]:
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str]] = []
    todo = [data]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            out += [(k, v) for k, v in x.items() if k in PROMPT_KEYS and isinstance(v, str)]
            todo += [v for v in x.values() if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            todo += [v for v in x if isinstance(v, (dict, list))]
    return out


def _extract_prompts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            name = path or ""
            found = _python_prompts(text or "") if name.endswith(".py") else _json_prompts(text or "") if name.endswith(".json") else [("", text or "")] if name.endswith((".md", ".txt")) else []
            rows += [(path, n, t.strip()) for n, t in found if t.strip()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "name", "prompt"])


def extract_prompts(files: DataFrame) -> DataFrame:
    """(path, name, prompt) of (path, text): whole Markdown and text files, prompt fields of JSON, and variables and docstrings of Python that hold prompts."""
    return files.select("path", "text").mapInArrow(_extract_prompts, "path string, name string, prompt string")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "HIGH", 1).when(severity == "MEDIUM", 2).otherwise(3)
