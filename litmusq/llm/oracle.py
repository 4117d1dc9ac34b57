"""SQL twins of the queries on texts that SQL can express on whole tables: exact pairs by brute force."""

_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+'))"
_RECORDS = f"""r AS (SELECT pair_id, regexp_replace(lower(split), '[^a-z]', '', 'g') AS sp, {", ".join(f"{_WORDS.format(c)} AS {c[0]}" for c in ("anchor", "positive", "negative"))} FROM adversarial_pairs WHERE pair_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1)"""


def _alike(c: str) -> str:
    same = f"len(list_intersect(x.{c}, y.{c}))"
    small, large = f"least(len(x.{c}), len(y.{c}))", f"greatest(len(x.{c}), len(y.{c}))"
    return f"CASE WHEN {small} = 0 OR {small} < 0.7 * {large} THEN false ELSE {same} >= 0.7 * (len(x.{c}) + len(y.{c}) - {same}) END"


_NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_CLASSES = f"""d AS (SELECT pair_id, {_NORM.format("positive")} AS tp, {_NORM.format("negative")} AS tn FROM adversarial_pairs WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1),
k AS (SELECT tp, tn, min(pair_id) AS class_id, count(*) AS copies, list_distinct(string_split(tp, ' ')) AS p, list_distinct(string_split(tn, ' ')) AS n FROM d WHERE tp <> '' AND tn <> '' GROUP BY tp, tn)"""
SQL: dict[str, str] = {
    "p1_found": f"""WITH {_RECORDS} SELECT least(x.pair_id, y.pair_id) AS pair_id_a, greatest(x.pair_id, y.pair_id) AS pair_id_b FROM r x JOIN r y ON x.sp = 'train' AND y.sp IN ('test', 'heldout', 'adversarial')
        WHERE {_alike("a")} AND {_alike("p")} AND {_alike("n")}""",
    "p2_found": f"WITH {_RECORDS} SELECT x.pair_id AS pair_id_a, y.pair_id AS pair_id_b FROM r x JOIN r y ON x.pair_id < y.pair_id WHERE {_alike('n')} AND {_alike('p')}",
    "p2_links": f"""WITH {_CLASSES}, l AS (SELECT x.class_id, count(*) AS links FROM k x JOIN k y ON x.class_id <> y.class_id WHERE {_alike("n")} AND {_alike("p")} GROUP BY x.class_id)
        SELECT d.pair_id, k.class_id, copies, coalesce(links, 0) AS links FROM d JOIN k ON k.tp = d.tp AND k.tn = d.tn LEFT JOIN l ON l.class_id = k.class_id""",
}
