"""Text-plane queries over documents, read as pages of their source where pages are needed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions.text import unwrap
from spanloom.operators import text as T
from spanloom.plans.base import load, registrar, sql_values, values

QUERIES, ORACLE_SQL, register = registrar()

TRIM = r"regexp_replace(regexp_replace({x}, '^[\s ]+', ''), '[\s ]+$', '')"


def trim(x: str) -> str:
    return TRIM.format(x=x)


#: A page is a document, its document is (source, lang).
PAGES = "SELECT source || '/' || lang AS doc_id, doc_id AS page, text FROM documents"


def pages(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang").alias("doc_id"), F.col("doc_id").alias("page"), "text")


@register(f"SELECT doc_id, length({trim('text')}) < 20 AS skipped FROM documents")
def scanned_pages(spark, sf_dir):
    return T.scanned_pages(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "skipped")


SIGS = rf"""
    l AS (SELECT doc_id, page, list_filter(string_split(text, chr(10)), lambda x: {trim('x')} <> '') AS ls FROM p),
    e AS (SELECT doc_id, page, unnest(list_distinct([ls[1], ls[-1]])) AS line FROM l WHERE len(ls) > 0),
    s AS (SELECT DISTINCT doc_id, page, lower(regexp_replace({trim('line')}, '[0-9]+', '#', 'g')) AS sig FROM e)"""


#: The same pages with a running head and foot, numbered.
HEADED = "SELECT source || '/' || lang AS doc_id, doc_id AS page, 'Volume ' || source || '/' || lang || chr(10) || text || chr(10) || '- ' || doc_id || ' -' AS text FROM documents"


@register(f"""
    WITH p AS ({HEADED}), {SIGS}, n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1)
    SELECT doc_id, sig, count(DISTINCT page) AS on_pages FROM s JOIN n USING (doc_id) GROUP BY doc_id, sig, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, ceil(pages * 0.5))""")
def running_lines(spark, sf_dir):
    head, foot = F.concat(F.lit("Volume "), "doc_id", F.lit("\n")), F.concat(F.lit("\n- "), F.col("page").cast("string"), F.lit(" -"))
    return T.running_lines(pages(spark, sf_dir).withColumn("text", F.concat(head, "text", foot)))


@register(f"WITH p AS ({PAGES}), {SIGS} SELECT sig, count(*) AS on_pages FROM s GROUP BY sig HAVING count(*) > 1")
def edge_line_counts(spark, sf_dir):
    return T.edge_lines(pages(spark, sf_dir)).groupBy("sig").agg(F.count("*").alias("on_pages")).where("on_pages > 1")


UNWRAP_STEPS = [
    (r"\r\n?", r"\n"), (r"[ \t ]+\n", r"\n"), (r"(\p{L})-\n(\p{Ll})", r"\1\2"), (r"(\p{L})-\n(\p{Lu})", r"\1-\2"), (r"\n[ \t\r\f ]*\n[\s ]*", "\u0001"),
    (r"\n", " "), (r"[ \t ]+", " "), (" *\u0001 *", r"\n\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""),
]


def unwrap_sql(x: str) -> str:
    for a, b in UNWRAP_STEPS:
        new = "'" + b + "'" if "\\n" not in b else "'' || " + " || ".join(["chr(10)"] * b.count("\\n"))
        x = f"regexp_replace({x}, '{a}', {new}, 'g')"
    return x


@register(f"SELECT doc_id, sha256({unwrap_sql('text')}) AS body, length({unwrap_sql('text')}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    body = load(spark, sf_dir, "documents").select("doc_id", unwrap(F.col("text")).alias("b"))
    return body.select("doc_id", F.sha2("b", 256).alias("body"), F.length("b").cast("long").alias("n"))


@register(f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    t AS (SELECT doc_id, line_no, {trim('line')} AS t FROM l),
    w AS (SELECT *, max(length(t)) OVER (PARTITION BY doc_id) AS longest, lead(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM t)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, t AS heading FROM w
    WHERE length(t) > 0 AND length(t) < 0.6 * longest AND NOT regexp_matches(t, '[.!?,;:-]$') AND regexp_matches(after, '^[\\p{{Lu}}\\p{{N}}]')""")
def headings(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return T.headings(lines).select("doc_id", "line_no", "heading")


@register("""
    WITH p AS (SELECT source || '/' || lang AS d, doc_id AS page, n_chars, coalesce(sum(n_chars) OVER w, 0) AS s FROM documents
               WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT d, sum(n_chars) AS total FROM p GROUP BY d), o AS (SELECT d, CAST(floor(total * i / 7) AS BIGINT) AS off FROM t, (SELECT unnest(range(0, 8)) AS i))
    SELECT o.d, off, coalesce(min(p.page) FILTER (p.s + p.n_chars > off), max(p.page)) AS page FROM o JOIN p USING (d) GROUP BY ALL""")
def page_lookup(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("d"), "doc_id", "n_chars")
    w = Window.partitionBy("d").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = d.withColumn("end", F.sum("n_chars").over(w)).groupBy("d").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("page"), (F.col("end") - F.col("n_chars")).alias("start"), "end"))).alias("page_map"), F.sum("n_chars").alias("total"))  # numbers only, as a book's page map has them
    off = spans.select("d", "page_map", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(F.col("total") * i / 7))).alias("off"))
    return off.select("d", "off", T.page_at(F.col("page_map"), F.col("off")).cast("long").alias("page")).distinct()


@register(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS askable FROM documents")
def askable_count(spark, sf_dir):
    """Runs of letters and digits: what can be asked about, before possessives, abbreviations and numbers are told apart."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("askable"))


def segmented(spark, sf_dir, *parts):
    return T.segment(load(spark, sf_dir, "documents").select("doc_id", "text"), parts=parts)


@register()
def sentences(spark, sf_dir):
    s = segmented(spark, sf_dir, "sentences").select("doc_id", F.posexplode("sentences").alias("sent_idx", "s"))
    return s.select("doc_id", "sent_idx", "s.start", "s.end")


@register()
def tokens(spark, sf_dir):
    return T.tokens_of(segmented(spark, sf_dir, "tokens"))


@register()
def token_kind_counts(spark, sf_dir):
    t = segmented(spark, sf_dir, "tokens").select(F.explode("tokens").alias("t"))
    return t.groupBy("t.kind").agg(F.count("*").alias("n"))


@register()
def chunks(spark, sf_dir):
    return segmented(spark, sf_dir, "chunks").select("doc_id", F.inline("chunks"))


#: Sentences of our own with the tokens they must have: text/kind, by one space.
EXAMPLES = [
    (1, "Ms. A. B. Nkemelu left M&S in the U.K. with 2,750.25 on Mt. Kenya.", "Ms./word A./word B./word Nkemelu/word left/word M&S/word in/word the/word U.K./word with/word 2,750.25/number on/word Mt./word Kenya/word ./punct"),
    (2, "Nokia's Espoo-based crew saw D'Arcy & Sons.", "Nokia/word 's/possessive Espoo/word -/punct based/word crew/word saw/word D'Arcy/word &/punct Sons/word ./punct"),
    (3, "NASA'S 3rd (2021-06-30) test: 12.5%!", "NASA/word 'S/possessive 3/number rd/word (/punct 2021-06-30/number )/punct test/word :/punct 12.5%/number !/punct"),
]


@register("SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, regexp_replace(x, '/[a-z]+$', '') AS text, regexp_extract(x, '[a-z]+$') AS kind FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS x, unnest(range(1, len(string_split(t, ' ')) + 1)) AS i FROM (VALUES " + sql_values([(i, t) for i, _, t in EXAMPLES]) + ") v(doc_id, t))")
def token_examples(spark, sf_dir):
    docs = values(spark, [(i, t) for i, t, _ in EXAMPLES], "doc_id bigint, text string")
    return T.tokens_of(T.segment(docs)).select("doc_id", "tok_idx", "text", "kind")


@register()
def normalize_pages(spark, sf_dir):
    """Documents of a source and language joined as pages of one, fifty pages a document."""
    d = load(spark, sf_dir, "documents")
    book = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"))
    done = T.normalize_pages(d.select(book.alias("doc_id"), F.col("doc_id").alias("page"), "text"))
    return done.select("doc_id", "page_count", F.size("page_map").alias("pages"), F.size("skipped_pages").alias("skipped"), F.length("text").alias("n_chars"), "sha256")
