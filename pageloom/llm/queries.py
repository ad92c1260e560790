"""The registered queries of the text-preparation operators; each runs over its whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import leaks, lookalike, overlap, pieces, quality, sentences, splits, tokens
from pageloom.llm.folding import CASELESS
from pageloom.llm.lookalike import ALIKE_TAGS, HYPHENS, LETTER_CLASSES, UNLIKE
from pageloom.plans.oracle import nfkc
from pageloom.session import spread, table, written

KEYS = {"page_data": "page_id", "document_chunks": "chunk_row_id", "evidence": "evidence_id"}


def _rows(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(table_name, row_id, text) of several tables."""
    parts = [spread(table(spark, sf_dir, x)).select(F.lit(x).alias("table_name"), F.col(KEYS[x]).alias("row_id"), "text") for x in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, *KEYS)
    return lookalike.lookalike_members(rows, ["table_name"], "row_id", "text", lookalike.fit(rows.select("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_lookalikes(spark, sf_dir), ["table_name"])


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and different strings look like each row."""
    return lookalike.lookalike_classes(_lookalikes(spark, sf_dir), ["table_name"]).drop("class")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, *KEYS)
    return rows.select("table_name", "row_id", lookalike.consistent_form(F.col("text"), lookalike.fit(rows.select("text"))).alias("form"))


def _each(spark: SparkSession, sf_dir: str, names: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    parts = [operator(_rows(spark, sf_dir, x)).select(F.lit(x).alias("table_name"), "*") for x in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, ("page_data", "document_chunks"), lambda rows: pieces.oversized_rows(rows, "row_id", "text"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, ("page_data", "document_chunks"), lambda rows: pieces.split_rows(rows, "row_id", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mixed_questions(table(spark, sf_dir, "questions"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.deal_splits(splits.question_groups(table(spark, sf_dir, "questions")), table(spark, sf_dir, "split_targets"))


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations that hold the groups together: the spanning forest by name."""
    return splits.forest_citations(table(spark, sf_dir, "questions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf_dir, "questions")).select("id_a", "id_b").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "questions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, ("page_data", "evidence"), lambda rows: sentences.sentence_units(rows, "row_id", "text").select("row_id", "end_char"))


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, ("page_data", "evidence"), lambda rows: sentences.sentence_units(rows, "row_id", "text", with_text=True))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(spread(table(spark, sf_dir, "documents")))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids decode to."""
    return tokens.decode_ids(written(p6_ids(spark, sf_dir)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_places(spark, sf_dir).select("doc_id", "item_id")


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "heldout_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), keep=["doc_id"]).where("kind <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), keep=["doc_id"]).select("doc_id", *quality.STATISTICS, "kind", "prose_probability")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_classes, p1_forms, p2_found, p2_pieces, p3_found, p3_splits, p3_forest, p4_found, p4_report, p5_found, p5_units, p6_ids, p6_texts, p7_found, p7_places, p8_found, p8_statistics)
    return {x.__name__: x for x in own}


_WIDTHLESS = "[\\x00-\\x08\\x0E-\\x1F\\x7F\\x{AD}\\x{34F}\\x{61C}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
_BLANKS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{85}]+"


def _looks(column: str) -> str:
    """SQL for the consistent form of a text, up to the choice of representatives: equal for texts that look the same."""
    single, long = [], []
    for point in (*range(0xA0, 0x3400), *range(0xF900, 0x10000)):
        tag, _, parts = unicodedata.decomposition(chr(point)).rpartition("> ")
        if tag and f"{tag}>" in ALIKE_TAGS and chr(point) not in UNLIKE:
            whole = unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in parts.split()))
            (single if len(whole) == 1 else long).append((chr(point), whole))
    alike = [(x, group[0]) for group in (*LETTER_CLASSES, HYPHENS) for x in group[1:]]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda found: ", ".join(quote("".join(x)) for x in zip(*found))
    sql = f"regexp_replace({column}, '{_WIDTHLESS}', '', 'g')"
    for char, whole in (x for x in long if x[0] in "ﬀﬁﬂﬃﬄﬅﬆ℃℉…‥№™㎏㎞㎝㎜"):
        sql = f"replace({sql}, {quote(char)}, {quote(whole)})"
    return f"trim(regexp_replace(nfc_normalize(translate(translate(nfc_normalize({sql}), {pairs(single)}), {pairs(alike)})), '{_BLANKS}', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    """SQL where the result of a query can be said in it; the others are tested against brute force and round trips."""
    measured = f"length(trim(regexp_replace(nfc_normalize(regexp_replace(text, '{_WIDTHLESS}', '', 'g')), '{_BLANKS}', ' ', 'g')))"
    alike, caseless = [(x, group[0]) for group in (*LETTER_CLASSES, HYPHENS) for x in group[1:]], [(chr(x), y) for x, y in CASELESS.items()]
    quoted = lambda pairs: ", ".join("'" + "".join(x).replace("'", "''") + "'" for x in zip(*pairs))
    plain = nfkc("regexp_replace(regexp_extract(replace(e.source, chr(92), '/'), '[^/]*$'), '" + _WIDTHLESS + "', '', 'g')")
    name = f"trim(regexp_replace(translate(lower(translate({plain}, {quoted(alike)})), {quoted(caseless)}), '{_BLANKS}', ' ', 'g'))"
    shown = " UNION ALL ".join(f"SELECT '{x}' AS table_name, {key} AS id, text, {_looks('text')} AS looks FROM {x} WHERE text IS NOT NULL" for x, key in KEYS.items())
    return {
        "p1_found": f"WITH f AS (SELECT * FROM ({shown}) WHERE looks <> '') SELECT DISTINCT a.table_name, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.table_name = b.table_name AND a.looks = b.looks AND a.id < b.id AND a.text <> b.text",
        "p1_classes": f"""WITH f AS (SELECT * FROM ({shown}) WHERE looks <> ''), n AS (SELECT table_name, looks, count(*) AS "rows", count(DISTINCT text) AS strings FROM f GROUP BY ALL)
            SELECT f.table_name, f.id, "rows", strings FROM f JOIN n USING (table_name, looks)""",
        "p3_found": f"""WITH RECURSIVE e AS (SELECT id, unnest(evidence) AS e FROM questions), c AS (SELECT DISTINCT id, {name} || '#' || e.page AS page FROM e WHERE e.source IS NOT NULL AND e.page IS NOT NULL AND {name} <> ''),
            r AS (SELECT DISTINCT a.id, b.id AS other FROM c a JOIN c b USING (page) UNION SELECT r.id, b.id FROM r JOIN c a ON a.id = r.other JOIN c b USING (page))
            SELECT r.id FROM r JOIN questions q ON q.id = r.other WHERE q.split IS NOT NULL GROUP BY r.id HAVING count(DISTINCT q.split) > 1""",
        "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p2_found": f"SELECT 'page_data' AS table_name, page_id AS row_id FROM page_data WHERE {measured} > 1000 "
        f"UNION ALL SELECT 'document_chunks' AS table_name, chunk_row_id AS row_id FROM document_chunks WHERE {measured} > 1000",
    }
