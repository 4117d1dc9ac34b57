"""File sources: directory scans, traces, repaired JSON, artifacts and search results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmusq.operators.traces import parse_lines

#: What a scan takes and leaves, and the characters it reads of a file.
INCLUDE = ["*.py", "*.json", "*.jsonl", "*.yaml", "*.yml", "*.md", "*.txt", "*.toml", "*.cfg", "*.rst"]
EXCLUDE = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".pytest_cache"]
READ_CHARS = 65536


def _like(globs: list[str]) -> str:
    return "(?i)^(?:" + "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs) + ")$"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, relative_path, size_bytes, text) of a folder, names by glob, excluded parts left out, in order of path.

    Texts are decoded as UTF-8 and cut after 65,536 characters, as the scan is to classify files.
    """
    any_case = lambda g: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in g)
    names = "{" + ",".join(map(any_case, include or INCLUDE)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    parts = F.split("path", "/")
    base = root.rstrip("/").split("/")[-1]
    kept = files.where(F.element_at(parts, -1).rlike(_like(include or INCLUDE)) & ~F.exists(parts, lambda p: p.rlike(_like(exclude or EXCLUDE))))
    text = F.substring(F.decode(F.col("content"), "UTF-8"), 1, READ_CHARS)
    relative = F.substring_index("path", f"/{base}/", -1)
    return kept.select("path", relative.alias("relative_path"), F.col("length").alias("size_bytes"), text.alias("text")).orderBy("path")


def trace_files(spark: SparkSession, root: str) -> DataFrame:
    """Steps of all trace files of a folder: JSONL by line, JSON by ``steps``; an unknown extension is tried as both."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.decode(F.col("content"), "UTF-8").alias("text"))
    single = F.from_json("text", "steps array<string>")["steps"]
    whole = F.col("path").endswith(".json") & single.isNotNull()
    lines = F.when(whole | (~F.col("path").endswith(".jsonl") & single.isNotNull()), single).otherwise(F.split("text", r"\r?\n"))
    return parse_lines(files.select(F.col("path").alias("trace"), F.posexplode(lines).alias("line", "text")))


_FENCE = regex.compile(r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$")


def repaired(text: str | None) -> str | None:
    """The JSON in a model's answer: fences off, from the first bracket, closed where it was cut; None without any.

    The longest prefix that ends behind a value is closed with the brackets
    still open, so a value cut in the middle is dropped.
    """
    if not text:
        return None
    body = _FENCE.sub("", text.strip())
    begin = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body = body[begin:]
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(value, ensure_ascii=False)
    except ValueError:
        pass
    stack: list[str] = []
    ends: list[tuple[int, str]] = []
    quoted = escaped = False
    for i, c in enumerate(body):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
            if not quoted:
                ends.append((i + 1, "".join(reversed(stack))))
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            ends.append((i + 1, "".join(reversed(stack))))
        elif c in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            ends.append((i, "".join(reversed(stack))))
    bad = len(body)  # what is wrong here is wrong in every prefix that reaches beyond it
    for end, close in reversed(ends):
        if end > bad:
            continue
        try:
            return json.dumps(json.loads(body[:end] + close), ensure_ascii=False)
        except json.JSONDecodeError as e:
            bad = min(bad, e.pos) if e.pos < end else bad
        except ValueError:
            continue
    return None


def answered(text: str | None) -> str | None:
    """The JSON text the stages take from a model's answer, None where they report a parse error.

    As they do: what is inside the first fence, the rest where it never closes;
    if that doesn't parse, all open brackets are closed, then what follows the
    last balanced bracket is left out.
    """
    body = (text or "").strip()
    for fence in ("```json", "```"):
        start = body.find(fence)
        if start >= 0:
            start += len(fence)
            end = body.find("```", start)
            body = (body[start:end] if end > start else body[start:]).strip()
            break
    braces = brackets = balanced = 0
    for m in re.finditer(r"[{}\[\]]", body):
        c = m.group()
        braces += (c == "{") - (c == "}")
        brackets += (c == "[") - (c == "]")
        if c in "}]" and braces == brackets == 0:
            balanced = m.end()
    tries = [body]
    if braces > 0 or brackets > 0:
        tries.append(body.rstrip().rstrip(",") + "]" * brackets + "}" * braces)
    if balanced > 10:
        tries.append(body[:balanced])
    for t in tries:
        try:
            json.loads(t)
            return t
        except (ValueError, RecursionError):
            continue
    return None


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([repaired(t) for t in batch.column(1).to_pylist()], pa.string())], ["id", "json"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([answered(t) for t in batch.column("raw_response").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("result_id", "run_id", "stage_num")], texts], ["result_id", "run_id", "stage_num", "raw_response"])


def answered_json(results: DataFrame) -> DataFrame:
    """(result_id, run_id, stage_num, raw_response) with the JSON text of every answer that has some."""
    kinds = dict(results.dtypes)
    one = results.select("result_id", "run_id", "stage_num", "raw_response")
    return one.mapInArrow(_answer, f"result_id {kinds['result_id']}, run_id {kinds['run_id']}, stage_num {kinds['stage_num']}, raw_response string").where("raw_response IS NOT NULL")


def repair_json(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): the repaired JSON of every answer, null where there is none."""
    out = answers.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(_repair, "id string, json string")
    return out.select(F.col("id").cast(dict(answers.dtypes)[key]).alias(key), "json")


def panel(answers: DataFrame, text: str) -> DataFrame:
    """Rows (name, payload) of panel JSON in any of its shapes: {"responses": [...]}, [...] or an object by name."""
    t = F.ltrim(F.col(text))
    listed = F.coalesce(F.from_json(t, "responses array<string>")["responses"], F.when(t.startswith("["), F.from_json(t, "array<string>")))
    keyed = F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("payload")))
    plain = F.transform(listed, lambda p: F.struct(F.lit(None).cast("string").alias("name"), p.alias("payload")))
    return answers.select(*[c for c in answers.columns if c != text], F.explode(F.coalesce(plain, keyed)).alias("r")).select(*[c for c in answers.columns if c != text], "r.*")


def artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact, or no row if the file is missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def merged_summaries(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Outer merge on a key; where both have a value the first one's holds."""
    shared = [c for c in first.columns if c != key and c in second.columns]
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, key, "full")
    extra = [c for c in first.columns if c not in (*shared, key)] + [c for c in second.columns if c not in (*shared, key)]
    return both.select(key, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in shared], *extra)


def search_results(found: DataFrame, cap: int) -> DataFrame:
    """Search hits (query_no, rank, url, ...) with every url once, the first kept, and at most ``cap`` of them."""
    order = Window.partitionBy("url").orderBy("query_no", "rank")
    once = found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return once.orderBy("query_no", "rank").limit(cap)
