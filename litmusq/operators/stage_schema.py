"""Schema checks of staged JSON outputs and of generated artifacts: one row per error, none for a sound one.

Fields are looked at as text (``map<string,string>``), so absent is told from
null or empty without knowing the rest of the object.  Text that is no JSON
object (or list, where one is due) has the one error that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per stage the fields of an output: name, what it must be ('any', 'list', 'dict', or 'items' with required fields), the items' fields, if an empty list (or object) is enough for them.
FIELDS: dict[int, list[tuple[str, str, list[str], str]]] = {
    1: [("target_variable", "any", [], ""), ("causal_research", "items", ["source_id", "title", "claim", "causal_variable", "effect_direction", "mechanism", "evidence_strength"], ""), ("research_tensions", "items", ["claim", "variables"], "")],
    2: [("target_variable", "any", [], ""), ("causal_nodes", "items", ["node_id", "label", "role", "definition", "mechanism", "evidence"], "[]"), ("causal_edges", "items", ["from", "to", "relationship", "claim"], ""), ("causal_tensions", "any", [], ""), ("summary_theory", "any", [], "")],
    3: [("target_variable", "any", [], ""), ("measurement_research", "items", ["source_id", "causal_node", "measurement_claim", "text_features", "implementation_ideas"], "[]")],
    4: [("target_variable", "any", [], ""), ("scorers", "items", ["scorer_id", "hypothesis", "causal_nodes_used", "functional_form", "functional_form_rationale", "expected_failure_mode", "code"], "[]")],
    5: [("target_variable", "any", [], ""), ("pairs", "items", ["pair_id", "anchor", "positive", "negative", "split", "target_delta", "controlled_variables"], "[]{}")],
    6: [("scorer_evaluations", "dict", [], ""), ("scorer_summaries", "list", [], ""), ("pareto_frontier", "list", [], "")],
    7: [("failure_patterns", "items", ["pattern_id", "scorer_ids", "reasoning_error"], "[]"), ("mutation_instructions", "items", ["instruction_id", "instruction"], ""), ("heldout_aggregate_only", "any", [], "")],
    8: [("target_variable", "any", [], ""), ("repair_scorers", "items", ["scorer_id", "hypothesis", "causal_nodes_used", "functional_form", "code"], "[]")],
}
SIGNATURE = "def scorer(text, anchor, params)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _falsy(value: Column, allowed: str) -> Column:
    """Null, false, zero or empty; an empty list or object only where it is not ``allowed``."""
    empties = ["", "false", "0", "0.0", *[e for e in ("[]", "{}") if e not in allowed]]
    return value.isNull() | F.trim(value).isin(empties)


def _field(top: Column, name: str, kind: str, required: list[str], allowed: str) -> Column:
    value = F.trim(F.try_element_at(top, F.lit(name)))
    missing = F.array(F.lit(f"missing top-level field: {name}"))
    found = _none()
    if kind == "dict":
        found = F.when(F.coalesce(value.startswith("{"), F.lit(False)), _none()).otherwise(F.array(F.lit(f"{name} must be a dict")))
    elif kind in ("list", "items"):
        bad = F.array(F.lit(f"{name} must be a list"))
        inner = _none()
        if kind == "items":
            items = F.from_json(value, "array<string>")

            def of(item: Column, i: Column) -> Column:
                x = F.coalesce(F.from_json(item, "map<string,string>"), F.create_map().cast("map<string,string>"))  # what is no object has no field
                at = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
                errors = [F.when(_falsy(F.try_element_at(x, F.lit(f)), allowed), F.concat(at, F.lit(f" missing or empty: {f}"))) for f in required]
                if "code" in required:
                    code = F.try_element_at(x, F.lit("code"))
                    errors.append(F.when((F.coalesce(code, F.lit("")) != "") & ~F.contains(code, F.lit(SIGNATURE)), F.concat(at, F.lit(f" code must define: {SIGNATURE}"))))
                return F.array_compact(F.array(*errors))

            inner = F.coalesce(F.flatten(F.transform(items, of)), _none())
        found = F.when(F.coalesce(value.startswith("["), F.lit(False)), inner).otherwise(bad)
    return F.when(F.map_contains_key(top, F.lit(name)), found).otherwise(missing)


def stage_errors(outputs: DataFrame, key: str, stage: str = "stage_num", text: str = "raw_response") -> DataFrame:
    """(key, stage, place, error) of JSON outputs, in the order of the checks."""
    top = F.from_json(F.col(text), "map<string,string>")
    per = F.when(F.lit(False), _none())
    for n, fields in FIELDS.items():
        per = per.when(F.col(stage) == n, F.concat(*[_field(top, *f) for f in fields]))
    errors = F.when(F.ltrim(text).startswith("{") & top.isNotNull(), per).otherwise(F.array(F.lit("not a JSON object")))
    return outputs.where(F.col(stage).isin(*FIELDS)).select(key, F.col(stage).alias("stage"), F.posexplode(errors).alias("place", "error"))


#: Fields of the items of generated lists.
LISTS = {"Pairs": ["pair_id", "anchor", "positive", "negative", "pair_type"], "Candidates": ["candidate_id", "strategy", "text"]}


def _list_errors(text: Column, name: str) -> Column:
    items = F.from_json(text, "array<string>")

    def of(x: Column, i: Column) -> Column:
        here = F.from_json(x, "map<string,string>")
        lacks = [F.when(~F.map_contains_key(here, F.lit(f)), F.concat(F.lit("item "), i.cast("string"), F.lit(f" missing '{f}' field"))) for f in LISTS[name]]
        return F.when(F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)) & here.isNotNull(), F.array_compact(F.array(*lacks))).otherwise(F.array(F.concat(F.lit("item "), i.cast("string"), F.lit(" is not a dict"))))

    errors = F.when(F.size(items) == 0, F.array(F.lit("empty list"))).otherwise(F.flatten(F.transform(items, of)))
    return F.when(F.coalesce(F.ltrim(text).startswith("["), F.lit(False)) & items.isNotNull(), errors).otherwise(F.array(F.lit("not a list")))


def artifact_errors(artifacts: DataFrame, key: str, kind: str = "kind", text: str = "payload") -> DataFrame:
    """(key, kind, place, error) of generated artifacts of kind 'research', 'taste_map', 'pairs' or 'candidates'."""
    t = F.col(text)
    top = F.from_json(t, "map<string,string>")
    quoted = F.from_json(t, "map<string,variant>")
    is_object = F.coalesce(F.ltrim(t).startswith("{"), F.lit(False)) & top.isNotNull()
    wrong = F.array_sort(F.map_keys(F.map_filter(quoted, lambda k, v: ~F.coalesce((F.schema_of_variant(v) == "STRING") & (F.trim(F.try_element_at(top, k)) != ""), F.lit(False)))))
    research = F.when(F.size(F.map_keys(top)) < 2, F.array(F.lit("too few keys"))).otherwise(F.transform(wrong, lambda k: F.concat(F.lit("invalid value for key '"), k, F.lit("'"))))
    listed = lambda n: F.coalesce(F.size(F.from_json(F.try_element_at(top, F.lit(n)), "array<string>")) >= 1, F.lit(False))
    taste = F.array_compact(F.array(F.when(~F.map_contains_key(top, F.lit("goal")), F.lit("missing 'goal'")), *[F.when(~listed(n), F.lit(f"missing or empty '{n}' list")) for n in ("rewards", "punishes")]))
    no_dict = F.array(F.lit("not a dict"))
    errors = (
        F.when(F.col(kind) == "research", F.when(is_object, research).otherwise(no_dict))
        .when(F.col(kind) == "taste_map", F.when(is_object, taste).otherwise(no_dict))
        .when(F.col(kind) == "pairs", _list_errors(t, "Pairs"))
        .when(F.col(kind) == "candidates", _list_errors(t, "Candidates"))
    )
    return artifacts.select(key, F.col(kind).alias("kind"), F.posexplode(errors).alias("place", "error"))
