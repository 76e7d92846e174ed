"""Registered queries: sources, text and paragraphs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import merge as M
from ..functions import text as T
from ..operators import text as OT
from ..sources import samples
from . import fixtures as X
from . import oracle_parts as O

# --- fixtures in SQL --------------------------------------------------------------

SOFT = "src AS (SELECT doc_id, source, replace(text, ', ', ','||chr(10)) AS text FROM documents)"
NOISY = """src AS (SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN replace(text, chr(10), chr(13)||chr(10))
  WHEN 1 THEN replace(text, ', ', ','||chr(160))
  WHEN 2 THEN replace(text, '. ', '.'||chr(9)||'  ')
  ELSE replace(text, chr(10), repeat(chr(10), 4)) END AS text FROM documents)"""
_MARKS = "[" + ", ".join(O.lit(s) for s in X.SEPARATORS) + "]"


def scened_sql(attached=False) -> str:
    t = f"replace(text, '. ', '.'||chr(10)||({_MARKS})[doc_id % 7 + 1]||chr(10))"
    if not attached:
        t = f"replace({t}, chr(10), chr(10)||chr(10))"
    return f"src AS (SELECT doc_id, {t} AS text FROM documents)"


def dialogue_line_sql(line="raw") -> str:
    return (
        f"CASE WHEN i % 10 = 8 THEN '\"' || rtrim({line}, '.') "
        f"WHEN i % 5 = 1 THEN '\"' || rtrim({line}, '.') || ',\"' "
        f"WHEN i % 5 = 2 THEN 'she said ' || lower({line}) "
        f"WHEN i % 5 = 4 THEN rtrim({line}, '.') "
        f"WHEN i % 5 = 0 AND i > 0 THEN lower({line}) ELSE {line} END"
    )


DOC_LINES = f"dl AS ({O.lines_of('documents', 'doc_id, source', 'text')})"
DIALOGUE = f"""{DOC_LINES},
src AS (SELECT doc_id, source, string_agg({dialogue_line_sql()}, chr(10) ORDER BY i) AS text FROM dl GROUP BY doc_id, source)"""
MIXED = f"""{DOC_LINES},
src AS (SELECT doc_id, string_agg('  ' || replace({dialogue_line_sql()}, ', ', ','||chr(10)) || CASE i % 7
   WHEN 3 THEN chr(13)||chr(10)||'* * *' WHEN 5 THEN repeat(chr(10), 4)||'---'||repeat(chr(10), 2)
   WHEN 6 THEN ' '||chr(9)||' '||chr(10)||' '||chr(10) ELSE '' END, chr(13)||chr(10) ORDER BY i) AS text
   FROM dl GROUP BY doc_id)"""
LINE_ITEMS = f"""itl AS ({O.lines_of('src', 'doc_id, source', 'text')}),
it AS (SELECT doc_id, source, i, {O.strip('raw')} AS text, CASE WHEN {O.scene(O.strip('raw'))} THEN 'scene' ELSE 'p' END AS kind
       FROM itl WHERE {O.strip('raw')} <> '')"""

# settings of the clean_text query: name, soft wraps, dialogue, collapse, preserve
SETTINGS = (
    ("standard", True, True, True, True),
    ("edit", False, False, True, True),
    ("pairs", False, True, True, True),
    ("loose", False, True, False, True),
    ("flat", True, False, True, False),
    ("flat-pairs", False, True, True, False),
    ("spacious", True, True, False, True),
)


def clean_text_query(spark, sf) -> DataFrame:
    settings = spark.createDataFrame(
        list(SETTINGS), "setting string, soft boolean, dia boolean, coll boolean, keep boolean")
    rows = X.mixed(spark, sf).crossJoin(F.broadcast(settings))
    cols = [F.col(c) for c in ("soft", "dia", "coll", "keep")]
    cleaned = F.when(F.col("setting") == "standard", T.clean_text(F.col("text")))
    cleaned = cleaned.when(
        F.col("setting") == "flat", T.clean_text(F.col("text"), True, False, True, False))
    return rows.select("doc_id", "setting", cleaned.otherwise(T.clean_text(F.col("text"), *cols)).alias("text"))


def clean_text_strict(spark, sf) -> DataFrame:
    """The second dialect: strict joins, no-break spaces kept; with and without soft wraps.
    Every third text is one paragraph with no-break spaces: its line ends are commas."""
    c = _nbsp_mixed(spark, sf)
    return c.select(
        "doc_id", *[T.clean_text(F.col("text"), soft, strict=True, nbsp=False).alias(name)
                    for name, soft in (("wrapped", True), ("paired", False))])


def _nbsp_mixed(spark, sf) -> DataFrame:
    kept = F.replace("text", F.lit(", "), F.lit(",\u00a0 "))
    joined = F.replace(kept, F.lit("\n"), F.lit(", "))
    mixed = X.mixed(spark, sf).withColumnRenamed("text", "mixed")
    return X.documents(spark, sf).join(mixed, "doc_id").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, joined).when(F.col("doc_id") % 3 == 1, kept)
        .otherwise(F.replace("mixed", F.lit(" "), F.lit(" \u00a0"))).alias("text"))


def _items(df, dedupe=False):
    return OT.explode_items(OT.with_items(df, dedupe=dedupe), ["doc_id"])


def _filtered(spark, sf):
    df = OT.with_items(X.scened(spark, sf), dedupe=True)
    keep = F.col("doc_id") % 2 == 0
    return OT.explode_items(df.withColumn("items", M.filter_scene_breaks(F.col("items"), keep)), ["doc_id"])


def merge_dialogue(spark, sf):
    """Flagship: soft-wrapped paragraphs before and after merging, per source."""
    return OT.merge_report(OT.line_items(X.soft_wrapped(spark, sf)), "source")


def _line_items(spark, sf, aggressive):
    items = OT.line_items(X.dialogue(spark, sf))
    return OT.explode_items(OT.merged(items, aggressive), ["doc_id"])


QUERIES = {
    "text_lines": lambda s, d: OT.text_lines(X.noisy(s, d), ["doc_id"]),
    "labelled_samples": lambda s, d: samples.labelled_samples(X.sample_files(s, d)),
    "normalize_line_endings": lambda s, d: X.noisy(s, d).select(
        "doc_id", T.normalize_line_endings(F.col("text")).alias("text")),
    "normalize_spaces": lambda s, d: X.noisy(s, d).select(
        "doc_id", T.normalize_spaces(F.col("text")).alias("text"),
        T.normalize_spaces(F.col("text"), nbsp=False).alias("text_keeping_nbsp")),
    "scene_break_lines": lambda s, d: OT.scene_break_lines(X.scened(s, d, True), ["doc_id"]),
    "text_blocks": lambda s, d: OT.text_blocks(X.mixed(s, d), ["doc_id"]),
    "dialogue_line_join": lambda s, d: OT.dialogue_lines(X.mixed(s, d), ["doc_id"]),
    "dialogue_line_join_strict": lambda s, d: OT.dialogue_lines(X.mixed(s, d), ["doc_id"], strict=True),
    "soft_wrap_join": lambda s, d: OT.soft_wrapped_blocks(X.mixed(s, d), ["doc_id"]),
    "collapse_blank_lines": lambda s, d: X.noisy(s, d).select(
        "doc_id", T.collapse_blank_lines(F.col("text")).alias("text")),
    "clean_text": clean_text_query,
    "clean_text_strict": clean_text_strict,
    "paragraph_items": lambda s, d: _items(X.scened(s, d)),
    "dedupe_scene_breaks": lambda s, d: _items(
        X.scened(s, d).withColumn("text", F.regexp_replace("text", r"\n\n(\S{3,4})\n\n", "\n\n$1\n\n$1\n\n$1\n\n")), True),
    "filter_scene_breaks": _filtered,
    "merge_dialogue": merge_dialogue,
    "merge_dialogue_items": lambda s, d: _line_items(s, d, False),
    "merge_dialogue_aggressive": lambda s, d: _line_items(s, d, True),
}


def _oracles() -> dict[str, str]:
    k = "doc_id"
    nb = O.block_chain("a", "src", k)
    items = O.items_chain("a", "aclean", k)
    settings = ", ".join("(" + ", ".join([O.lit(r[0])] + [str(x).lower() for x in r[1:]]) + ")" for r in SETTINGS)
    idx = f"(row_number() OVER (PARTITION BY {k} ORDER BY chunk))::INT - 1 AS item_idx"
    dedup = f"""al AS (SELECT *, lag(kind) OVER (PARTITION BY {k} ORDER BY chunk) AS prev FROM aitems),
ad AS (SELECT * FROM al WHERE NOT (kind = 'scene' AND coalesce(prev, '') = 'scene'))"""

    def pairs(strict):
        return f"""WITH {MIXED},{nb},{O.pair_chain('a', k, strict)}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT - 1 AS out_idx, line FROM aout"""

    tripled = ("src AS (SELECT doc_id, regexp_replace(text, '\\n\\n(\\S{3,4})\\n\\n', "
               "chr(10)||chr(10)||'\\1'||chr(10)||chr(10)||'\\1'||chr(10)||chr(10)||'\\1'||chr(10)||chr(10), 'g') AS text FROM src0)")
    prev = "lag(text) OVER (PARTITION BY doc_id ORDER BY i)"
    return {
        "text_lines": f"""WITH {NOISY}, l AS ({O.lines_of('src', k, 'text')})
SELECT doc_id, i AS line_idx, {O.strip('raw')} AS line FROM l""",
        "labelled_samples": f"""WITH {DOC_LINES},
l AS (SELECT doc_id, i, CASE WHEN i % 4 = 2 THEN ' === ' || raw || ' ===' ELSE raw || '  ' END AS s FROM dl),
h AS (SELECT *, starts_with({O.strip('s')}, '===') AND ends_with({O.strip('s')}, '===') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM h),
b AS (SELECT doc_id, (grp - 1)::INT AS sample_idx, max(CASE WHEN head THEN {O.strip(f"trim({O.strip('s')}, '=')")} END) AS name,
      {O.strip("coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT head), '')")} AS body FROM g WHERE grp > 0 GROUP BY doc_id, grp)
SELECT d.doc_id::VARCHAR AS path, sample_idx, name, body, CASE WHEN sample_idx IS NULL THEN 'no_samples' END AS error
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id""",
        "normalize_line_endings": f"""WITH {NOISY}
SELECT doc_id, replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)) AS text FROM src""",
        "normalize_spaces": f"""WITH {NOISY}, c AS (SELECT doc_id, text, replace(text, chr(160), ' ') AS n FROM src)
SELECT doc_id, regexp_replace(regexp_replace(n, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS text,
       regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS text_keeping_nbsp FROM c""",
        "scene_break_lines": f"""WITH {scened_sql(True)}, l AS ({O.lines_of('src', k, 'text')})
SELECT doc_id, i AS line_idx, {O.strip('raw')} AS line, {O.scene(O.strip('raw'))} AS is_scene FROM l""",
        "text_blocks": f"""WITH {MIXED},{nb}
SELECT doc_id, block_idx, min(kind) AS kind, min(i)::INT AS first_line, count(*)::INT AS n_lines,
       string_agg(s, chr(10) ORDER BY i) AS text FROM ablk GROUP BY doc_id, block_idx""",
        "dialogue_line_join": pairs(False),
        "dialogue_line_join_strict": pairs(True),
        "soft_wrap_join": f"""WITH {MIXED},{nb},
b AS (SELECT doc_id, block_idx, {O.strip("regexp_replace(string_agg(s, ' ' ORDER BY i), ' {2,}', ' ', 'g')")} AS text
      FROM ablk WHERE kind = 'text' GROUP BY doc_id, block_idx)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_idx))::INT - 1 AS block_no, text FROM b""",
        "collapse_blank_lines": f"""WITH {NOISY}
SELECT doc_id, {O.strip("regexp_replace(text, '\\n{3,}', chr(10)||chr(10), 'g')")} AS text FROM src""",
        "clean_text": f"""WITH {MIXED}, settings(setting, soft, dia, coll, keep) AS (VALUES {settings}),
x AS (SELECT * FROM src, settings),{O.clean_chain('a', 'x', 'doc_id, setting, soft, dia, coll, keep', 'text', 'soft', 'dia', 'coll', 'keep')}
SELECT doc_id, setting, cleaned AS text FROM aclean""",
        "clean_text_strict": f"""WITH {MIXED.replace("src AS (", "mx AS (")},
src AS (SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN replace(replace(d.text, ', ', ',' || chr(160) || ' '), chr(10), ', ')
  WHEN 1 THEN replace(d.text, ', ', ',' || chr(160) || ' ') ELSE replace(mx.text, ' ', ' ' || chr(160)) END AS text
  FROM documents d JOIN mx ON mx.doc_id = d.doc_id),
{O.clean_chain('w', 'src', k, strict=True, nbsp=False)}, {O.clean_chain('p', 'src', k, soft='false', strict=True, nbsp=False)}
SELECT doc_id, wclean.cleaned AS wrapped, pclean.cleaned AS paired FROM wclean JOIN pclean USING (doc_id)""",
        "paragraph_items": f"""WITH {scened_sql()},{O.clean_chain('a', 'src', k)},{items}
SELECT doc_id, {idx}, kind, text FROM aitems""",
        "dedupe_scene_breaks": f"""WITH {scened_sql().replace('src AS', 'src0 AS', 1)}, {tripled},{O.clean_chain('a', 'src', k)},{items},{dedup}
SELECT doc_id, {idx}, kind, text FROM ad""",
        "filter_scene_breaks": f"""WITH {scened_sql()},{O.clean_chain('a', 'src', k)},{items},{dedup}
SELECT doc_id, {idx}, kind, text FROM ad WHERE kind <> 'scene' OR doc_id % 2 = 0""",
        "merge_dialogue": f"""WITH {SOFT}, {LINE_ITEMS},
f AS (SELECT *, kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = 'p' AND {O.merge_plain(prev, 'text')} AS m FROM it)
SELECT source, count(*) AS paragraphs_before, count(*) FILTER (NOT coalesce(m, false)) AS paragraphs_after,
       count(*) FILTER (coalesce(m, false)) AS paragraphs_merged FROM f GROUP BY source""",
        "merge_dialogue_items": f"""WITH {DIALOGUE}, {LINE_ITEMS},
f AS (SELECT *, CASE WHEN kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = 'p' AND {O.merge_plain(prev, 'text')}
      THEN 0 ELSE 1 END AS opens FROM it),
g AS (SELECT *, (sum(opens) OVER (PARTITION BY doc_id ORDER BY i))::INT - 1 AS item_idx FROM f)
SELECT doc_id, item_idx, min(kind) AS kind, string_agg(text, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, item_idx""",
        "merge_dialogue_aggressive": f"""WITH {DIALOGUE}, {LINE_ITEMS}, f AS ({O.merge_fold('it', k, 'i', 'true', 'true')})
{O.unfold('f', k)}""",
    }


ORACLES = _oracles()
