"""Registered queries of the engine's operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import Config
from ..functions import text as tx, vectors as vc
from ..operators import history as hs, pages as pg, search as sr, store as st
from ..operators.chunking import chunk_rows
from ..operators.vector_index import VectorIndex
from ..shared import numbered, scratch, tasks_of
from ..sources import dumps as dp, index as ix, multistream as ms
from . import service as sv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT vec_id, round(s, 6) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select("embedding").first()[0]  # one vector
    return sr.top_k(e, q, 10, ties=("vec_id",)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH t AS (SELECT doc_id, text, string_split_regex(text, '[ \\t\\n\\r]+') AS w FROM documents),
s AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) <= 128 THEN [0] ELSE range(0, len(w), 118) END) AS a, CASE WHEN len(w) <= 128 THEN 1 ELSE len(range(0, len(w), 118)) END AS n FROM t)
SELECT doc_id, (a // 118 + 1)::INT AS chunk_index, n::INT AS chunk_count, CASE WHEN len(w) <= 128 THEN text ELSE array_to_string(w[a + 1 : a + 128], ' ') END AS content FROM s""")
def token_chunks(spark, d):
    return chunk_rows(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), 128, 10).select("doc_id", "chunk_index", "chunk_count", "content")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]+)</title>", 1).alias("title"))


@query("SELECT nullif(props::JSON ->> 'k', '') AS dump_date FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC LIMIT 1")
def latest_dump_date(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))
    h = e.join(F.broadcast(first), F.col("event_type") == F.col("t")).select(F.lit("cron").alias("service_name"), F.lit("new").alias("status"), F.regexp_replace("props", '"k"', '"dump_date"').alias("metadata"), F.col("ts").alias("timestamp"))
    return hs.latest_dump_date(h, "cron", "new")


@query("SELECT doc_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS seed FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def rng_seed(spark, d):
    return table(spark, d, "documents").select("doc_id", vc.seed_of(F.col("text")).alias("seed"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""WITH o AS (SELECT doc_id, doc_id // 10 AS g, n_chars FROM documents), b AS (SELECT g, sum(n_chars)::BIGINT AS n FROM o GROUP BY g), s AS (SELECT g, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM b)
SELECT a AS start, lead(a) OVER (ORDER BY a) AS "end" FROM s""")
def offset_ranges(spark, d):
    """Ten documents to a stream; offsets are running sums of n_chars, and an index holds a hundred streams."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.expr("doc_id div 10").alias("g"))
    sizes = numbered(docs.groupBy("g").agg(F.sum("n_chars").alias("n")), "g", add="n").select("g", F.col("before").alias("offset"))
    lines = docs.join(sizes, "g").select(F.col("doc_id").alias("line_no"), "offset", F.expr("g div 100").alias("index_file"))
    ranges = ix.byte_ranges(lines, by="index_file")
    # the last range of an index ends where the next index begins
    first = sizes.groupBy((F.expr("g div 100") - 1).alias("index_file")).agg(F.min("offset").alias("next"))
    return ranges.join(first, "index_file", "left").select("start", F.coalesce("end", "next").alias("end"))


@query("WITH r AS (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 20 AS g FROM events) SELECT g::BIGINT AS batch_group, round(avg(value), 6) AS average FROM r GROUP BY g HAVING count(*) = 20")
def batch_average(spark, d):
    return hs.batch_averages(table(spark, d, "events").select("event_id", "value"), 20, "event_id", "value").select("batch_group", F.round("average", 6).alias("average"))


@query("""WITH i AS (SELECT user_id, event_type, max(ts) AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2), s AS (SELECT user_id, event_type, ts FROM events WHERE ts < TIMESTAMP '2024-01-20')
SELECT user_id::INT AS pid, event_type AS source, ts AS last_modified_date FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = i.user_id AND s.event_type = i.event_type AND s.ts >= i.ts)""")
def stale_filter(spark, d):
    e = table(spark, d, "events")
    one = [F.col("user_id").cast("int").alias("pid"), F.col("event_type").alias("source")]
    incoming = e.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy(*one).agg(F.max("ts").alias("last_modified_date"))
    return st.stale(incoming, e.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).select(*one, F.col("ts").alias("last_modified_date")))


_PAGE = """'<page><title>T' || doc_id || '</title><ns>' || CASE WHEN doc_id % 5 = 4 THEN '1' ELSE '0' END || '</ns><id>' || doc_id || '</id>' || CASE WHEN doc_id % 7 = 3 THEN '<redirect title="x" />' ELSE '' END || '<timestamp>2024-01-02T03:04:05Z</timestamp><text bytes="1">' || CASE WHEN doc_id % 11 = 5 THEN '  #redirect ' ELSE '' END || CASE WHEN doc_id % 3 <> 0 THEN '[[Link]] ' ELSE '' END || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text></page>'"""


@query(f"""WITH x AS (SELECT {_PAGE} AS p FROM documents),
e AS (SELECT p, regexp_extract(p, '(?s)<title>(.*?)</title>', 1) AS name, regexp_extract(p, '(?s)<id>(\\d+)</id>', 1)::INT AS pid, regexp_extract(p, '(?s)<id>\\d+</id>.*?<text[^>]*>(.*?)</text>', 1) AS content FROM x)
SELECT pid, name, md5(content) AS content_md5 FROM e WHERE contains(p, '<ns>0</ns>') AND NOT regexp_matches(p, '<redirect[ \\t\\n\\r]') AND NOT regexp_matches(content, '(?is)^[ \\t\\n\\r]*#REDIRECT') AND regexp_matches(content, '\\[\\[[^\\]]+\\]\\]') AND name <> '' AND content <> ''""")
def article_filter(spark, d):
    xml = table(spark, d, "documents").select(F.expr(_PAGE).alias("xml"))
    return pg.articles(pg.parse_pages(pg.split_pages(xml).withColumn("page", F.concat(F.lit("<page>"), "page", F.lit("</page>"))))).select("pid", "name", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH s AS (SELECT doc_id::INT AS pid, CASE WHEN lang <> 'de' THEN source END AS source, n_chars AS n, lang FROM documents), i AS (SELECT pid, source, n + 1 AS n FROM s WHERE lang IN ('de', 'en'))
SELECT pid, source, n FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.pid = s.pid AND i.source IS NOT DISTINCT FROM s.source) UNION ALL SELECT * FROM i""")
def upsert_by_key(spark, d):
    """The whole table is the store; the articles of two languages come in anew, those of one of them under a null source."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("pid"), F.when(F.col("lang") != "de", F.col("source")).alias("source"), F.lit(1).alias("chunk_index"), F.lit(None).cast("timestamp").alias("last_modified_date"), F.col("n_chars").alias("n"), "lang")
    incoming = docs.filter(F.col("lang").isin("de", "en")).withColumn("n", F.col("n") + 1)
    return st.upsert(docs.drop("lang"), incoming.drop("lang")).select("pid", "source", "n")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 0")
def delete_by_key(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "source")
    return st.without_articles(docs, docs.filter("pid % 10 = 0")).select(F.col("pid").alias("doc_id"), "source")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey = (SELECT min(p_partkey) FROM part WHERE p_name = (SELECT min(p_name) FROM part))""")
def retrieve_by_title(spark, d):
    """Lines of orders are chunks of their part's article; they are stored, and found by name through the file index."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    title = part.agg(F.min("name")).first()[0]
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    if tasks := tasks_of(spark, lines.count()):
        lines = lines.repartition(tasks, "l_partkey")  # an article's lines are numbered in one task
    content = F.to_json(F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    # an article's chunks are numbered by order and line
    number = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    chunks = lines.join(part, "l_partkey").select(F.col("l_partkey").cast("int").alias("pid"), "name", number.alias("chunk_index"), F.lit(1).alias("chunk_count"), content.alias("content"), F.lit("enwiki").alias("source"), F.lit(None).cast("timestamp").alias("last_modified_date"), F.lit(None).cast("array<float>").alias("embedding"))
    store = st.ChunkStore(spark, scratch(spark, "store"))
    store.upsert(chunks)
    back = F.from_json("content", "l_orderkey long, l_linenumber int, l_quantity double")
    return store.retrieve(title).select(back.alias("b")).select("b.*")


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY event_id DESC")
def run_history_desc(spark, d):
    return hs.newest_first(table(spark, d, "events").withColumn("id", F.col("event_id"))).select("event_id", "user_id", "event_type", "ts")


@query("SELECT count(*) > 0 AS found FROM events WHERE user_id = 13")
def run_exists(spark, d):
    return hs.run_exists(table(spark, d, "events").select(F.col("user_id").alias("run_id")), 13).agg((F.count("*") > 0).alias("found"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'enwiki' WHEN 1 THEN 'frwiki' END AS source_code FROM documents")
def source_class(spark, d):
    name = F.concat(F.element_at(F.array(F.lit("enwiki"), F.lit("frwiki"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("-2024-index.txt.bz2"))
    return table(spark, d, "documents").select("doc_id", tx.source_of(name).alias("source_code"))


@query("SELECT page_id, replace(url, 'http://', 'https://') AS secure_url, string_split(url, '/')[-1] AS file_name FROM pages")
def url_rewrite_filename(spark, d):
    return table(spark, d, "pages").select("page_id", tx.https_url(F.col("url")).alias("secure_url"), tx.file_name(F.col("url")).alias("file_name"))


@query("""SELECT '/d/' || lower(n_name) || n_nationkey || '.xml.bz2' AS dump, '/d/' || lower(n_name) || '-index' || n_nationkey || '.txt.bz2' AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""")
def dump_pairing(spark, d):
    """An index for each nation, beside side files of the same names; dumps for those outside one region."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sides = nations.withColumn("end", F.explode(F.array(F.lit(".txt.bz2"), F.lit(".txt.bz2:Zone.Identifier"))))
    i = sides.select(F.concat(F.lit("/d/"), F.lower("n_name"), F.lit("-index"), "n_nationkey", "end").alias("path")).select("path", tx.file_name(F.col("path")).alias("name"))
    x = nations.filter("r_name <> 'ASIA'").select(F.concat(F.lit("/d/"), F.lower("n_name"), F.col("n_nationkey"), F.lit(".xml.bz2")).alias("path"), F.lit(1).cast("long").alias("length"))
    return ix.pair_dumps(i, x).select("dump", "path")


@query("SELECT lang, count(*)::BIGINT AS items FROM documents GROUP BY lang")
def stage_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("items"))


@query("SELECT doc_id, try_cast('2024-01-' || lpad((doc_id % 40)::VARCHAR, 2, '0') || ' 03:04:05' AS TIMESTAMP) AS parsed FROM documents")
def timestamp_parse(spark, d):
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("T03:04:05Z"))
    return table(spark, d, "documents").select("doc_id", tx.iso_timestamp(stamp).cast("timestamp_ntz").alias("parsed"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, (i - 1)::INT AS pos, round(CASE WHEN n > 0 THEN v[i] / n ELSE v[i] END, 5) + 0.0 AS value FROM n, unnest(range(1, 65)) t(i)""")
def l2_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vc.l2_normalise(F.col("embedding"))).alias("pos", "value")).select("vec_id", "pos", (F.round("value", 5) + F.lit(0.0)).alias("value"))  # no negative zero


@query("SELECT vec_id, embedding[1]::FLOAT AS first, len(embedding[1:16])::INT AS dimension FROM embeddings")
def truncate_vector(spark, d):
    v = vc.to_floats(vc.truncate(F.col("embedding"), 16))
    return table(spark, d, "embeddings").select("vec_id", v[0].alias("first"), F.size(v).alias("dimension"))


@query("SELECT (('0x' || substr(sha256(string_agg(n_nationkey || n_name, '' ORDER BY n_nationkey)), 1, 8))::BIGINT & 2147483647)::BIGINT AS run_id FROM nation")
def run_fingerprint(spark, d):
    joined = table(spark, d, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.concat(s["n_nationkey"], s["n_name"])), "").alias("j"))
    return joined.select(F.conv(F.substring(F.sha2(F.col("j").cast("binary"), 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647)).alias("run_id"))


@query("SELECT md5(text) AS checksum FROM documents WHERE contains(lang || '-' || source, (SELECT max(source) FROM documents)) ORDER BY doc_id LIMIT 1")
def checksum_lookup(spark, d):
    """A list with a line per document: the hash of its text, then its language and source as a file name."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("line_no"), F.concat(F.md5(F.col("text").cast("binary")), F.lit("  "), "lang", F.lit("-"), "source").alias("value"))
    return dp.checksum_for(lines, F.lit(docs.agg(F.max("source")).first()[0]))  # one name


@query("SELECT doc_id, text AS content, source, NULL::VARCHAR AS last_modified_date, true AS keeps_nulls FROM documents")
def message_json(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "source", F.lit(None).cast("string").alias("last_modified_date")).withColumn("m", tx.to_message("content", "source", "last_modified_date"))
    back = F.from_json("m", "content string, source string, last_modified_date string")
    return m.select("doc_id", back["content"].alias("content"), back["source"].alias("source"), back["last_modified_date"].alias("last_modified_date"), F.contains("m", F.lit('"last_modified_date":null')).alias("keeps_nulls"))


@query("SELECT coalesce(source, '') AS source, count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS articles FROM documents GROUP BY ALL")
def size_by_source(spark, d):
    return st.size_by_source(table(spark, d, "documents").withColumn("pid", F.col("doc_id"))).select(F.coalesce("source", F.lit("")).alias("source"), "chunks", "articles")


@query("SELECT page_id, url AS link, 'day ' || (page_id // 100) AS published, page_id // 100 <> 0 AS is_new FROM pages")
def feed_check(spark, d):
    """A feed for each page that links to its url, dated by its id; the first days' feeds are known."""
    url = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.concat(F.lit("day "), F.expr("page_id div 100"))
    xml = F.concat(F.lit('<rss><channel><item><description>&lt;p&gt;&lt;a class="x" href="'), url, F.lit('"&gt;f&lt;/a&gt;</description><pubDate>'), day, F.lit("</pubDate></item><item><description>other</description></item></channel></rss>"))
    feeds = table(spark, d, "pages").select("page_id", xml.alias("x"))
    return feeds.select("page_id", dp.feed_link(F.col("x")).alias("link"), dp.feed_date(F.col("x")).alias("published"), dp.is_new(dp.feed_date(F.col("x")), F.lit("day 0")).alias("is_new"))


@query("SELECT doc_id, text AS plain FROM documents")
def markup_strip(spark, d):
    """Every text wrapped in markup comes back plain; markup characters of the texts' own are escaped first."""
    marked = F.concat(F.lit("{{Infobox|a=b}}<!-- c --><ref name='x'>y</ref>"), tx.escape_markup(F.col("text")))
    return table(spark, d, "documents").select("doc_id", tx.strip_markup(marked).alias("plain"))


@query()
def rng_embed(spark, d):
    run = vc.embed_with(lambda: vc.RandomEmbedder(64, 0))
    return table(spark, d, "documents").select("doc_id", run(F.col("text")).alias("embedding"))


@query("SELECT vec_id, (i - 1)::INT AS pos, embedding[i]::FLOAT AS value FROM embeddings, unnest(range(1, 65)) t(i)")
def embedding_codec(spark, d):
    """Every component of every vector, out of its message."""
    e = table(spark, d, "embeddings").select("vec_id", vc.encode_vector("embedding").alias("m"))
    return e.select("vec_id", F.posexplode(vc.decode_vector("m")).alias("pos", "value"))


@query("""SELECT vec_id, round(s, 6) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) ORDER BY s DESC, vec_id LIMIT 10""")
def ivf_topk(spark, d):
    """With as many probes as lists the inverted lists give the exact answer."""
    e = table(spark, d, "embeddings")
    lists = sr.InvertedLists(e, scratch(spark, "lists"), 8)
    q = e.filter("vec_id = 1").select("embedding").first()[0]
    return lists.search(q, 10, probes=8, ties=("vec_id",)).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _index(spark, d, lists: int, spill: int) -> VectorIndex:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.train(e, scratch(spark, "index"), ["vec_id"], lists, spill=spill)
    index.add(e)
    return index


@query("SELECT count(*)::BIGINT AS queries, 4 AS probes, 32 AS lists, true AS reached FROM embeddings WHERE vec_id % 10 = 0")
def ann_recall(spark, d):
    """Whether a search of an eighth of the lists finds nine tenths of the ten nearest others of each tenth vector."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = _index(spark, d, 32, 6).search(asked, 11, probes=4).select("query_id", "vec_id").filter("query_id <> vec_id")
    exact = sr.top_k_of(e, asked, 11, "vec_id").filter("query_id <> vec_id")
    share = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("hit").alias("hits"), F.count("*").alias("all"), F.count_distinct("query_id").alias("queries"))
    return share.select("queries", F.lit(4).alias("probes"), F.lit(32).alias("lists"), (F.col("hits") >= 0.9 * F.col("all")).alias("reached"))


@query()
def ann_topk(spark, d):
    """The approximate search's own answer for each hundredth vector."""
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _index(spark, d, 32, 6).search(asked, 10, probes=4)


def _dump(spark, d) -> str:
    """A folder with every document as a page of a dump; a fifth are of another namespace."""
    folder = scratch(spark, "dumps")
    ns = F.when(F.col("doc_id") % 5 == 4, "1").otherwise("0")
    head = [F.lit("<page><title>T"), "doc_id", F.lit("</title><ns>"), ns, F.lit("</ns><id>"), "doc_id", F.lit('</id><timestamp>2024-01-02T03:04:05Z</timestamp><text bytes="1">[[Link|]]')]
    page = F.concat(*head, tx.escape_markup(F.col("text")), F.lit("</text></page>"))
    ms.write_dump(table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.concat(F.lit("T"), "doc_id").alias("title"), page.alias("xml")), folder)
    return folder


@query("SELECT doc_id::INT AS pid, 'T' || doc_id AS name, md5(text) AS content_md5 FROM documents")
def range_scan(spark, d):
    """Every document as a page of a multistream dump, found by the byte ranges of its index, decompressed, parsed and cleaned."""
    pages = pg.clean(sv.Dumps(Config(content_folder=_dump(spark, d))).pages(spark))
    return pages.select("pid", "name", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH t AS (SELECT doc_id, text, string_split_regex(text, '[ \\t\\n\\r]+') AS w FROM documents WHERE doc_id % 5 <> 4),
s AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) <= 128 THEN [0] ELSE range(0, len(w), 118) END) AS a, CASE WHEN len(w) <= 128 THEN 1 ELSE len(range(0, len(w), 118)) END AS n FROM t)
SELECT doc_id::INT AS pid, 'T' || doc_id AS name, (a // 118 + 1)::INT AS chunk_index, n::INT AS chunk_count, md5(CASE WHEN len(w) <= 128 THEN text ELSE array_to_string(w[a + 1 : a + 128], ' ') END) AS content_md5, 'enwiki' AS source, 16 AS dimension FROM s""")
def stream_pipeline(spark, d):
    """A dump through the three stages as streams that run at once: pages in, chunks with vectors, store."""
    config = Config(content_folder=_dump(spark, d), work_folder=scratch(spark, "work"), dimension=16, max_tokens=128, overlap=10, concurrent=True)
    service = sv.Service(spark, config)
    service.INDEXED = 1 << 60  # nothing is searched
    service.run()
    return service.store.read().select("pid", "name", "chunk_index", "chunk_count", F.md5(F.col("content").cast("binary")).alias("content_md5"), "source", F.size("embedding").alias("dimension"))
