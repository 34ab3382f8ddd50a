"""Detectors, scoring and span resolution over letters and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.catalog import corpus, oracle, query
from veilscan.functions.spans import context_window
from veilscan.functions.text import rows_from_locator
from veilscan.operators import detect as det
from veilscan.operators.entities import entity_spans, new_entities, slices, wants_entities

DOCUMENTS_SQL = "SELECT doc_id AS path, 0 AS chunk_no, text FROM documents"
_COLUMNS = "path, chunk_no, category, value, s AS span_start, e AS span_end, round(confidence, 3) AS confidence"


def letters_source() -> str:
    return f"SELECT path, chunk_no, text FROM ({corpus.letters_sql()})"


def letter_chunks(spark, sf_dir) -> DataFrame:
    return corpus.letters(spark, sf_dir).select("path", "chunk_no", "text")


def document_chunks(spark, sf_dir) -> DataFrame:
    docs = corpus.texts(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("path"), F.lit(0).cast("bigint").alias("chunk_no"), "text")


def shown(found: DataFrame) -> DataFrame:
    """Spans with offsets as long integers."""
    return found.select(
        "path",
        "chunk_no",
        "category",
        "value",
        F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"),
        F.round("confidence", 3).alias("confidence"),
    )


def _register_letters(name: str) -> None:
    sql = oracle.spans(letters_source(), (name,), cut=None) + f"SELECT {_COLUMNS} FROM spans"

    @query(f"det_{name}", sql)
    def run(spark, sf_dir):
        # without a cut, so that weak candidates are compared as well
        return shown(det.detect(letter_chunks(spark, sf_dir), detectors=(name,), min_confidence=0.0))


for _name in oracle.ORDER:
    _register_letters(_name)


# Numbers of all kinds behind each given text, as the texts have none of the rarer ones themselves.
_NUMBERS = """chr(10) || 'тел. +7 9' || lpad(CAST({k} * 7919 % 100000000 AS STRING), 8, '0') || 'x, 89' || lpad(CAST({k} * 104729 % 1000000000 AS STRING), 9, '0')
  || '; СНИЛС ' || lpad(CAST({k} * 37 % 1000 AS STRING), 3, '0') || '-112-233 ' || lpad(CAST({k} % 100 AS STRING), 2, '0') || ', '
  || lpad(CAST({k} * 15485863 % 100000000000 AS STRING), 11, '0') || '; ИНН ' || lpad(CAST({k} * 32452843 % 10000000000 AS STRING), 10, '0') || ' и '
  || lpad(CAST({k} * 86028121 % 1000000000000 AS STRING), 12, '0')"""


def _numbered(key: str) -> str:
    return _NUMBERS.replace("{k}", key)


NUMBERED_SQL = f"SELECT doc_id AS path, 0 AS chunk_no, text || {_numbered('doc_id')} AS text FROM documents"
NUMBERED_TURNS_SQL = f"SELECT conv_id AS path, turn AS chunk_no, text || {_numbered('(conv_id * 31 + turn)')} AS text FROM conversations"


def _register_documents(name: str) -> None:
    sql = oracle.spans(NUMBERED_SQL, (name,)) + f"SELECT {_COLUMNS} FROM spans"

    @query(f"det_{name}_documents", sql)
    def run(spark, sf_dir):
        docs = corpus._run(spark, sf_dir, NUMBERED_SQL, "documents").withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
        return shown(det.detect(docs, detectors=(name,)))


for _name in ("email", "phone", "bank_card", "inn", "snils"):
    _register_documents(_name)


@query("detect_all_letters", oracle.spans(letters_source()) + f"SELECT {_COLUMNS} FROM spans")
def detect_all_letters(spark, sf_dir):
    return shown(det.detect(letter_chunks(spark, sf_dir)))


@query("detect_all_documents", oracle.spans(DOCUMENTS_SQL) + f"SELECT {_COLUMNS} FROM spans")
def detect_all_documents(spark, sf_dir):
    return shown(det.detect(document_chunks(spark, sf_dir)))


@query("detect_all_conversations", oracle.spans(NUMBERED_TURNS_SQL) + f"SELECT {_COLUMNS} FROM spans")
def detect_all_conversations(spark, sf_dir):
    return shown(det.detect(corpus._run(spark, sf_dir, NUMBERED_TURNS_SQL, "conversations")))


@query(
    "min_confidence",
    oracle.spans(letters_source(), cut=None)
    + "SELECT category, count(*) AS candidates, CAST(sum(CASE WHEN confidence >= 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS kept,"
    " CAST(sum(CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS sure FROM spans GROUP BY category",
)
def min_confidence(spark, sf_dir):
    found = det.detect(letter_chunks(spark, sf_dir), min_confidence=0.0)
    return found.groupBy("category").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("confidence") >= 0.6).alias("kept"),
        F.count_if(F.col("confidence") >= 0.9).alias("sure"),
    )


@query(
    "context_boost",
    oracle.spans(letters_source(), ("phone", "email", "fio", "birth_date"), cut=None)
    + "SELECT category, round(confidence, 3) AS confidence, count(*) AS spans FROM spans GROUP BY ALL",
)
def context_boost(spark, sf_dir):
    found = det.detect(
        letter_chunks(spark, sf_dir), detectors=("phone", "email", "fio", "birth_date"), min_confidence=0.0
    )
    return found.groupBy("category", F.round("confidence", 3).alias("confidence")).agg(F.count(F.lit(1)).alias("spans"))


@query(
    "span_dedup",
    oracle.spans(f"SELECT path, chunk_no, text || ' cvv ' || text AS text FROM ({letters_source()})", ("cvv",), cut=None)
    + f"SELECT {_COLUMNS} FROM spans",
)
def span_dedup(spark, sf_dir):
    doubled = letter_chunks(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" cvv "), "text"))
    return shown(det.detect(doubled, detectors=("cvv",), min_confidence=0.0))


# Every letter once as it is and once behind a marked cell, which switches the free-text detectors off.
_SWITCHED = f"""SELECT path || CASE m WHEN 1 THEN '#' ELSE '' END AS path, chunk_no, CASE m WHEN 1 THEN '[[PII_DIRECT:email:x@y.ru]]; ' ELSE '' END || text AS text
    FROM ({letters_source()}), (SELECT 0 AS m UNION ALL SELECT 1)"""


@query(
    "structured_switch",
    oracle.spans(_SWITCHED, cut=None)
    + """SELECT contains(path, '#') AS marked, category, count(*) AS spans, count(DISTINCT path) AS files FROM spans GROUP BY ALL""",
)
def structured_switch(spark, sf_dir):
    letters = letter_chunks(spark, sf_dir)
    marked = letters.select(F.concat("path", F.lit("#")).alias("path"), "chunk_no", F.concat(F.lit("[[PII_DIRECT:email:x@y.ru]]; "), "text").alias("text"))
    found = det.detect(letters.unionByName(marked), min_confidence=0.0)
    return found.groupBy(F.col("path").contains("#").alias("marked"), "category").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("path").alias("files"))


@query(
    "context_windows",
    f"""WITH t AS ({DOCUMENTS_SQL}),
    h AS ({oracle.hits('[0-9]+')})
    SELECT path, s AS span_start, {oracle.window(60)} AS near FROM h""",
)
def context_windows(spark, sf_dir):
    from veilscan.functions.spans import find_spans

    spans = document_chunks(spark, sf_dir).select("path", "text", F.explode(find_spans(F.col("text"), "[0-9]+")).alias("s"))
    return spans.select(
        "path",
        F.col("s.start").cast("bigint").alias("span_start"),
        context_window(F.col("text"), F.col("s.start"), F.col("s.end"), 60).alias("near"),
    )


@query(
    "entity_gate",
    f"""SELECT path, chunk_no, length(text) >= 50
      AND length(regexp_replace(text, '[^\\x{{0400}}-\\x{{04FF}}]', '', 'g')) >= 0.05 * length(text)
      AND NOT contains(text, '[[PII_DIRECT:') AS wanted
    FROM ({letters_source()} UNION ALL SELECT CAST(doc_id AS STRING), 0, text FROM documents)""",
)
def entity_gate(spark, sf_dir):
    docs = document_chunks(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    both = letter_chunks(spark, sf_dir).unionByName(docs)
    return both.select("path", "chunk_no", wants_entities(F.col("text")).alias("wanted"))


@query(
    "entity_slices",
    """SELECT path, o AS "offset", sha256(substr(text, o + 1, 1000)) AS slice_hash
    FROM (SELECT doc_id AS path, text, unnest(range(0, length(text), 1000)) AS o FROM documents WHERE length(text) > 0)""",
)
def entity_slices(spark, sf_dir):
    cut = slices(document_chunks(spark, sf_dir), 1000)
    return cut.select("path", F.col("offset").cast("bigint").alias("offset"), F.sha2("text", 256).alias("slice_hash"))


# Spans as a model would give them: one person or place per order, some of them noise.
_ENTITIES_SQL = """SELECT '/archive/client_' || CAST(o_custkey AS STRING) AS path, o_orderkey AS chunk_no,
  CASE o_orderkey % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'ORG' END AS type,
  CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 6 WHEN 0 THEN 'Иван Петров' WHEN 1 THEN 'Тверь' WHEN 2 THEN 'London' WHEN 3 THEN 'С. М.' WHEN 4 THEN 'Ян' ELSE 'Мск' END AS value,
  CAST(o_orderkey % 100 AS INT) AS start, CAST(o_orderkey % 100 + 5 AS INT) AS finish
FROM orders"""


def _entities(spark, sf_dir) -> DataFrame:
    return corpus._run(spark, sf_dir, _ENTITIES_SQL, "orders").withColumnRenamed("finish", "end")


@query(
    "entity_filter",
    f"""SELECT path, chunk_no, CASE type WHEN 'PER' THEN 'fio' ELSE 'address' END AS category, value,
      CAST(start AS BIGINT) AS span_start, CAST(finish AS BIGINT) AS span_end, CAST(0.85 AS DOUBLE) AS confidence
    FROM ({_ENTITIES_SQL})
    WHERE type IN ('PER', 'LOC') AND NOT regexp_matches(value, '[a-zA-Z]')
      AND regexp_matches(value, '[аеёиоуыэюяАЕЁИОУЫЭЮЯ]') AND length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) >= 3""",
)
def entity_filter(spark, sf_dir):
    return shown(entity_spans(_entities(spark, sf_dir)))


@query(
    "entity_merge",
    oracle.spans(letters_source(), ("fio", "fio_initials", "address", "postal"), cut=None)
    + """, model AS (SELECT path, chunk_no, 'fio' AS category, value, s, e FROM spans WHERE category = 'fio' AND chunk_no % 2 = 0
      UNION ALL SELECT path, chunk_no, 'fio', value || ' Петров', s, e + 7 FROM spans WHERE category = 'fio')
    SELECT m.path, m.chunk_no, m.category, m.value, m.s AS span_start, m.e AS span_end, CAST(0.85 AS DOUBLE) AS confidence
    FROM model m WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.path = m.path AND x.chunk_no = m.chunk_no
      AND x.category = m.category AND x.s = m.s AND x.e = m.e)""",
)
def entity_merge(spark, sf_dir):
    found = det.detect(
        letter_chunks(spark, sf_dir), detectors=("fio", "fio_initials", "address", "postal"), min_confidence=0.0
    )
    names = found.filter(F.col("category") == "fio").select(
        "path", "chunk_no", F.lit("PER").alias("type"), "value", "start", "end"
    )
    longer = names.withColumn("value", F.concat("value", F.lit(" Петров"))).withColumn("end", F.col("end") + 7)
    model = names.filter(F.col("chunk_no") % 2 == 0).unionByName(longer)
    return shown(new_entities(entity_spans(model), found))


@query(
    "rows_from_locator",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS row_count FROM documents""",
)
def rows_of_locator(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    locator = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("chunk=3:rows="), F.col("n_chars").cast("string"))).otherwise(
        F.lit("full")
    )
    return docs.select("doc_id", rows_from_locator(locator).alias("row_count"))
