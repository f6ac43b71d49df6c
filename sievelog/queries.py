"""Queries over the driver tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import socket
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, shared_dir
from .functions.json_lines import normalize_line, prepare
from .functions.text import first_token, is_token_char, normalize_token, token_list, tokenize, tokens
from .operators import postings as ps
from .operators.blocks import assign_blocks, block_metadata, number_lines
from .operators.search import SearchResult, matching, response, term_count
from .operators.store import Store
from .plans.compile import BLOCK, fetch, from_postings, predicate
from .plans.query import And, Not, Or, Query, QueryError, Term, display, from_json, parse_query
from .service import Service
from .sources.bodies import from_array_body, from_datagrams, split_lines
from .sources.sockets import LineServer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(text: str) -> str:
    """SQL for the normalized tokens of a text, in order and with repeats."""
    return rf"list_transform(list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> ''), lambda x: lower(x))"


def _sql_where(q: Query, held: str = "t") -> str:
    """SQL for a query over a list of tokens."""
    match q:
        case Term(text):
            return f"list_contains({held}, '{text}')" if text else "false"
        case And(children):
            return "(" + " AND ".join(_sql_where(c, held) for c in children) + ")" if children else "false"
        case Or(children):
            return "(" + " OR ".join(_sql_where(c, held) for c in children) + ")" if children else "false"
        case Not(child):
            return f"NOT {_sql_where(child, held)}"
    raise TypeError(q)


_DOCS = f"(SELECT doc_id, text, {_sql_list('text')} AS t FROM documents)"
_POSTINGS = f"(SELECT DISTINCT doc_id, unnest({_sql_list('text')}) AS term FROM documents)"


# Tokens


def _exploded(spark, sf_dir, column, name):
    # The outer form, as Spark would guard the plain one by a filter that works the tokens out a second time.
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(column).alias("pos", name)).filter(F.col("pos").isNotNull())


@query(r"""SELECT doc_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS token FROM
  (SELECT doc_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents)""")
def tokenize_raw(spark, sf_dir):
    """All tokens as written, with their places."""
    return _exploded(spark, sf_dir, tokenize("text"), "token")


@query(f"SELECT doc_id, (generate_subscripts(t, 1) - 1)::INTEGER AS pos, unnest(t) AS token FROM {_DOCS}")
def normalize_tokens(spark, sf_dir):
    return _exploded(spark, sf_dir, token_list("text"), "token")


@query(f"SELECT doc_id, term FROM {_POSTINGS}")
def tokenize_terms(spark, sf_dir):
    """The distinct terms of every document: the postings."""
    return ps.postings(table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("tokens")), ["doc_id"]).select("doc_id", "term")


@query(f"SELECT doc_id, coalesce(list_extract(t, 1), '') AS term FROM {_DOCS}")
def first_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", first_token("text").alias("term"))


@query(r"SELECT DISTINCT c, regexp_matches(c, '^[\p{L}\p{N}_]$') AS is_token, lower(c) AS normal FROM (SELECT unnest(string_split(html, '')) AS c FROM pages) WHERE c <> ''")
def token_chars(spark, sf_dir):
    """What the tokenizer makes of every character of the pages."""
    chars = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "")).alias("c")).filter("c <> ''").distinct()
    return chars.select("c", is_token_char(F.col("c")).alias("is_token"), normalize_token(F.col("c")).alias("normal"))


@query(f"SELECT len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, count(*) AS docs FROM {_DOCS} GROUP BY ALL")
def token_dedup(spark, sf_dir):
    """How many tokens documents have, and how many are left without repeats."""
    counts = table(spark, sf_dir, "documents").select(F.size(token_list("text")).cast("long").alias("n_tokens"), F.size(tokens("text")).cast("long").alias("n_terms"))
    return counts.groupBy("n_tokens", "n_terms").agg(F.count("*").alias("docs"))


# Search: a query text or tree, the table, its text and its key

_SEARCHES = {
    "search_term": "the",
    "search_and": "the AND of",
    "search_and_not": "the AND NOT of",
    "search_implicit_and": "the of",
    "search_or": "der OR que",
    "search_not": "NOT the",
    "search_nested": "the AND (of OR that) AND NOT is",
    "search_double_not": "NOT NOT the",
    "search_case_insensitive": "THE aNd nOt OF",
    "search_separators": "the-of",
    "search_leading_not": "not-the",
    "search_precedence": "der OR the of",
    "search_empty_query": "  ",
    "search_json_ast": {"and": [{"term": "the"}, {"not": {"or": [{"term": "of"}, {"term": "or"}]}}]},
    "search_json_literal_and": {"term": "and"},
    "search_json_words": {"term": "the=of"},
    "search_json_empty_and": {"and": []},
    "search_json_not_empty": {"not": {"or": []}},
    "search_json_single": {"or": [{"term": "of"}]},
}


def tree(q) -> Query:
    return parse_query(q) if isinstance(q, str) else from_json(q)


def _add_search(name: str, q) -> None:
    parsed = tree(q)

    def search(spark, sf_dir):
        return matching(table(spark, sf_dir, "documents"), parsed, line="text").select("doc_id")

    search.__name__, search.__doc__ = name, display(parsed)
    query(f"SELECT doc_id FROM {_DOCS} WHERE {_sql_where(parsed)}")(search)


for _name, _q in _SEARCHES.items():
    _add_search(_name, _q)


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_sql_list('text')} AS t FROM conversations) WHERE {_sql_where(tree('the OR der'))}")
def search_conversations(spark, sf_dir):
    return matching(table(spark, sf_dir, "conversations"), "the OR der", line="text").select("conv_id", "turn")


@query(f"SELECT page_id FROM (SELECT page_id, {_sql_list('html')} AS t FROM pages) WHERE {_sql_where(tree('es AND track'))}")
def search_pages(spark, sf_dir):
    return matching(table(spark, sf_dir, "pages"), "es AND track", line="html").select("page_id")


@query(f"""SELECT event_id FROM (SELECT event_id, {_sql_list("'type=' || event_type || ' user=' || user_id")} AS t FROM events) WHERE {_sql_where(tree('type=error user'))}""")
def search_key_value(spark, sf_dir):
    """`env=prod` finds lines with both words."""
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("type="), "event_type", F.lit(" user="), F.col("user_id").cast("string")).alias("line"))
    return matching(lines, "type=error user").select("event_id")


@query(f"SELECT 'the of' AS query, count(*) AS total FROM {_DOCS} WHERE {_sql_where(tree('the of'))}")
def search_total(spark, sf_dir):
    found = matching(table(spark, sf_dir, "documents"), "the of", line="text")
    return found.agg(F.count("*").alias("total")).select(F.lit("the of").alias("query"), "total")


@query(f"SELECT doc_id FROM {_DOCS} WHERE {_sql_where(tree('the of'))} ORDER BY doc_id LIMIT 25")
def search_limit(spark, sf_dir):
    """The first 25 in order; the limit is the operator."""
    found = matching(table(spark, sf_dir, "documents"), "the of", line="text").select("doc_id", F.col("text").alias("line"))
    return SearchResult(found, ["doc_id"], 25).rows.select("doc_id")


@query(f"""SELECT 'the of' AS query, least(count(*), 10)::BIGINT AS count, count(*) AS total, array_to_string(list(text ORDER BY doc_id)[:10], chr(10)) AS results
  FROM {_DOCS} WHERE {_sql_where(tree('the of'))}""")
def search_response(spark, sf_dir):
    found = matching(table(spark, sf_dir, "documents"), "the of", line="text").select("doc_id", F.col("text").alias("line"))
    answer = response(SearchResult(found, ["doc_id"], 10), "the of")
    return answer.withColumn("results", F.array_join("results", "\n"))


@query(f"SELECT count(*) AS count FROM {_DOCS} WHERE list_contains(t, 'the')")
def count_for_token(spark, sf_dir):
    return term_count(table(spark, sf_dir, "documents"), "the", tokens("text"))


# Postings


def _index(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("tokens"))
    return ps.postings(docs, ["doc_id"])


@query(f"SELECT term, count(*) AS num_ids, ceil(count(*) / 128)::BIGINT AS num_chunks FROM {_POSTINGS} GROUP BY term")
def inverted_index_df(spark, sf_dir):
    """The dictionary: every term with the number of its documents and of its chunks."""
    return ps.dictionary(_index(spark, sf_dir), [])


def _ids_sql(op: str) -> str:
    return f"SELECT doc_id FROM {_POSTINGS} WHERE term = 'the' {op} SELECT doc_id FROM {_POSTINGS} WHERE term = 'of'"


@query(_ids_sql("INTERSECT"))
def postings_semi(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ps.intersect(ps.ids_of(index, "the", "doc_id"), ps.ids_of(index, "of", "doc_id"), ["doc_id"])


@query(_ids_sql("UNION"))
def postings_union(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ps.union(ps.ids_of(index, "the", "doc_id"), ps.ids_of(index, "of", "doc_id"))


@query(_ids_sql("EXCEPT"))
def postings_anti(spark, sf_dir):
    index = _index(spark, sf_dir)
    return ps.difference(ps.ids_of(index, "the", "doc_id"), ps.ids_of(index, "of", "doc_id"), ["doc_id"])


def _per_block(spark, sf_dir) -> DataFrame:
    """For every block of 64 documents, the ids of two terms as arrays: bounded by the block."""
    index = _index(spark, sf_dir).withColumn("block_id", F.floor(F.col("doc_id") / 64).cast("long"))
    pick = lambda term: F.array_sort(F.coalesce(F.collect_set(F.when(F.col("term") == term, F.col("doc_id"))), F.array().cast("array<long>")))
    return index.filter(F.col("term").isin("the", "of")).groupBy("block_id").agg(pick("the").alias("a"), pick("of").alias("b"))


def _array_sql(expression: str) -> str:
    return f"""SELECT block_id, unnest(list_sort({expression})) AS doc_id FROM (SELECT doc_id // 64 AS block_id, coalesce(list(doc_id) FILTER (term = 'the'), []) AS a,
  coalesce(list(doc_id) FILTER (term = 'of'), []) AS b FROM {_POSTINGS} WHERE term IN ('the', 'of') GROUP BY 1)"""


@query(_array_sql("list_intersect(a, b)"))
def posting_intersect_array(spark, sf_dir):
    return _per_block(spark, sf_dir).select("block_id", F.explode(ps.intersect_ids(F.col("a"), F.col("b"))).alias("doc_id"))


@query(_array_sql("list_distinct(list_concat(a, b))"))
def posting_union_array(spark, sf_dir):
    return _per_block(spark, sf_dir).select("block_id", F.explode(ps.union_ids(F.col("a"), F.col("b"))).alias("doc_id"))


@query(_array_sql("list_filter(a, lambda x: NOT list_contains(b, x))"))
def posting_except_array(spark, sf_dir):
    return _per_block(spark, sf_dir).select("block_id", F.explode(ps.difference_ids(F.col("a"), F.col("b"))).alias("doc_id"))


def _add_indexed(name: str, q) -> None:
    parsed = tree(q)

    def search(spark, sf_dir):
        return from_postings(parsed, _index(spark, sf_dir), table(spark, sf_dir, "documents"), ["doc_id"])

    search.__name__, search.__doc__ = name, f"{display(parsed)}, from postings"
    query(f"SELECT doc_id FROM {_DOCS} WHERE {_sql_where(parsed)}")(search)


for _name, _q in {"indexed_and_not": "the AND NOT of", "indexed_not": "NOT the", "indexed_or_not": "der OR NOT the", "indexed_empty": {"and": []}, "indexed_all": {"not": {"term": ""}}}.items():
    _add_indexed(_name, _q)


#: Lists as a store has them: of each term in each block of 512 documents.
_LISTED = f"(SELECT DISTINCT doc_id // 512 AS block_id, (doc_id % 512)::INTEGER AS line_id, unnest({_sql_list('text')}) AS term FROM documents)"
_DELTAS = f"(SELECT *, line_id - coalesce(lag(line_id) OVER w, 0) AS delta, (row_number() OVER w - 1) // 128 AS chunk FROM {_LISTED} WINDOW w AS (PARTITION BY block_id, term ORDER BY line_id))"


def _listed(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 512").alias("block_id"), (F.col("doc_id") % 512).cast("int").alias("line_id"), tokens("text").alias("tokens"))
    return ps.postings(docs, ["block_id", "line_id"])


@query(f"SELECT block_id, term, line_id, delta FROM {_DELTAS}")
def posting_deltas(spark, sf_dir):
    return ps.deltas(_listed(spark, sf_dir), ["block_id", "term"], "line_id").select("block_id", "term", "line_id", "delta")


@query(f"SELECT block_id, term, line_id::BIGINT AS id FROM {_LISTED}")
def posting_roundtrip(spark, sf_dir):
    """Ids to deltas and back."""
    coded = ps.deltas(_listed(spark, sf_dir), ["block_id", "term"], "line_id")
    return ps.undelta(coded, ["block_id", "term"], "line_id").select("block_id", "term", "id")


@query(f"SELECT term, (count(*) // 128)::BIGINT AS full_chunks, (count(*) % 128)::BIGINT AS rest FROM {_POSTINGS} GROUP BY term")
def posting_chunks(spark, sf_dir):
    counts = _index(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n"))
    return counts.select("term", F.floor(F.col("n") / 128).alias("full_chunks"), (F.col("n") % 128).alias("rest"))


@query(f"""SELECT block_id, term, sum(n)::BIGINT AS num_ids, count(*) AS num_chunks, sum(CASE WHEN n = 128 THEN 1 + 16 * len(ltrim(bin(most), '0')) ELSE 5 + varints END)::BIGINT AS bytes FROM
  (SELECT block_id, term, chunk, count(*) AS n, max(delta) AS most, sum(CASE WHEN delta < 128 THEN 1 ELSE 2 END) AS varints FROM {_DELTAS} GROUP BY ALL) GROUP BY ALL""")
def posting_size_model(spark, sf_dir):
    """Bytes of every list: full chunks at the bits of their largest delta, the rest as varints."""
    return ps.coded_size(_listed(spark, sf_dir), ["block_id", "term"], "line_id")


@query(f"SELECT block_id, term, count(*) AS num_ids, array_to_string(list(line_id ORDER BY line_id), ' ') AS ids FROM {_LISTED} GROUP BY ALL")
def posting_lists(spark, sf_dir):
    """The lists themselves, ascending."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 512").alias("block_id"), (F.col("doc_id") % 512).cast("int").alias("line_id"), tokens("text").alias("tokens"))
    return ps.block_lists(docs).filter(F.col("term") != BLOCK).select("block_id", "term", "num_ids", F.array_join("ids", " ").alias("ids"))


# Blocks


def _blocks(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))
    return assign_blocks(number_lines(docs, ["doc_id"]), block_rows=256, pack_rows=32)


_BLOCKS = """(SELECT doc_id, text, n, n // 256 AS block_id, (n % 256)::INTEGER AS line_id, ((n % 256) // 32)::INTEGER AS pack_id
  FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents))"""


@query(f"SELECT doc_id, block_id, line_id, pack_id FROM {_BLOCKS}")
def block_assign(spark, sf_dir):
    """Rotation by count, and packs inside blocks."""
    return _blocks(spark, sf_dir).select("doc_id", "block_id", "line_id", "pack_id")


@query(f"""SELECT block_id, count(*) AS num_lines, 32 AS rows_per_pack, ceil(count(*) / 32)::INTEGER AS num_packs, sum(octet_length(encode(text)))::BIGINT AS data_size
  FROM {_BLOCKS} GROUP BY block_id""")
def block_meta(spark, sf_dir):
    return block_metadata(_blocks(spark, sf_dir), 32)


@query(f"SELECT block_id, pack_id, min(line_id) AS first_line, max(line_id) AS last_line, count(*) AS lines FROM {_BLOCKS} GROUP BY ALL")
def pack_assign(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("block_id", "pack_id").agg(F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"), F.count("*").alias("lines"))


@query(f"""SELECT block_id, term, count(*) AS num_ids, ceil(count(*) / 128)::BIGINT AS num_chunks FROM
  (SELECT DISTINCT block_id, line_id, unnest({_sql_list('text')}) AS term FROM {_BLOCKS}) GROUP BY ALL""")
def block_term_df(spark, sf_dir):
    lines = _blocks(spark, sf_dir).withColumn("tokens", tokens("line"))
    return ps.dictionary(ps.postings(lines, ["block_id", "line_id"]), ["block_id"])


_TIERED = f"""(SELECT *, CASE WHEN (block_id + 1) * 256 > (SELECT count(*) FROM documents) THEN 0 WHEN block_id >= 2 THEN 1 ELSE 2 END AS tier FROM {_BLOCKS})"""


@query(f"SELECT tier, block_id, line_id FROM (SELECT tier, block_id, line_id, {_sql_list('text')} AS t FROM {_TIERED}) WHERE list_contains(t, 'the') ORDER BY tier, block_id, line_id LIMIT 40")
def tiered_search_order(spark, sf_dir):
    """A store with two sealed blocks at most, then full ones not yet sealed, then an open one: the open one's lines come
    first, then those not yet sealed; the limit is the operator."""
    docs, store = table(spark, sf_dir, "documents"), _store(spark)
    first = docs.orderBy("doc_id").limit(512)
    store.ingest(first, "text", order=["doc_id"])
    store.append(docs.join(first.select("doc_id"), "doc_id", "left_anti"), "text", order=["doc_id"])
    return store.search("the", 40).rows.select("tier", "block_id", "line_id")


@query(f"SELECT block_id, line_id, text AS line FROM (SELECT *, {_sql_list('text')} AS t FROM {_BLOCKS}) WHERE list_contains(t, 'the') AND NOT list_contains(t, 'of')")
def fetch_lines(spark, sf_dir):
    """Keys from postings, then the lines of those keys."""
    lines = _blocks(spark, sf_dir).withColumn("tokens", tokens("line"))
    keys = from_postings(parse_query("the AND NOT of"), ps.postings(lines, ["block_id", "line_id"]), lines)
    return fetch(lines, keys).select("block_id", "line_id", "line")


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", Settings(block_rows=256, pack_rows=32))


@query("SELECT block_id FROM " + _BLOCKS + " GROUP BY block_id")
def list_block_ids(spark, sf_dir):
    """Block ids as a store gives them after all is sealed."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    store.flush()
    return store.block_ids()


_STORED = f"SELECT block_id, line_id FROM (SELECT block_id, line_id, {_sql_list('text')} AS t FROM {_BLOCKS}) WHERE {_sql_where(tree('the AND NOT of'))}"


@query(_STORED)
def store_search(spark, sf_dir):
    """The same search through a store: sealed blocks by their lists, the open block by its tokens."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    return store.search("the AND NOT of").matches.select("block_id", "line_id")


@query(_STORED)
def store_reopened(spark, sf_dir):
    """A store closed and opened again from its files alone."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    store.flush()
    return Store(spark, store.root, store.settings).search("the AND NOT of").matches.select("block_id", "line_id")


@query(f"SELECT block_id, line_id, pack_id, md5(text) AS line_md5 FROM {_BLOCKS}")
def store_lines(spark, sf_dir):
    """Every line read back from the sealed files."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    store.flush()
    return store.lines().select("block_id", "line_id", "pack_id", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


@query(f"""SELECT b.block_id, num_lines, num_packs, data_size, CASE WHEN (b.block_id + 1) * 256 > (SELECT count(*) FROM documents) THEN 'active' ELSE 'sealed' END AS tier,
  CASE WHEN (b.block_id + 1) * 256 > (SELECT count(*) FROM documents) THEN 0 ELSE idx_entries END AS idx_entries FROM
  (SELECT block_id, count(*) AS num_lines, ceil(count(*) / 32)::INTEGER AS num_packs, sum(octet_length(encode(text)))::BIGINT AS data_size FROM {_BLOCKS} GROUP BY block_id) AS b
  JOIN (SELECT block_id, count(DISTINCT term) AS idx_entries FROM (SELECT block_id, unnest({_sql_list('text')}) AS term FROM {_BLOCKS}) GROUP BY block_id) USING (block_id)""")
def store_blocks(spark, sf_dir):
    """What a store knows of its blocks: counted when they were sealed, or now if they are open."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    return store.blocks().drop("rows_per_pack")


@query(f"""SELECT 'the of' AS query, least(count(*), 10)::BIGINT AS count, count(*) AS total,
  array_to_string(list(text ORDER BY (n // 256 + 1) * 256 <= (SELECT count(*) FROM documents), n)[:10], chr(10)) AS results FROM
  (SELECT text, n, {_sql_list('text')} AS t FROM {_BLOCKS}) WHERE {_sql_where(tree('the of'))}""")
def service_search(spark, sf_dir):
    """The answer of the service to a request with a limit, over a store: lines of the open block come first."""
    store = _store(spark)
    store.ingest(table(spark, sf_dir, "documents"), "text", order=["doc_id"])
    answer = Service(spark, store).search("the of", 10)
    return spark.createDataFrame([(answer["query"], answer["count"], answer["total"], "\n".join(answer["results"]))], "query string, count long, total long, results string")


_SHOWN = {
    "a AND b OR c": "(a AND b) OR c",
    "not (a or b) c": "(NOT (a OR b)) AND c",
    "NOT NOT a": "NOT (NOT a)",
    "env=prod": "env AND prod",
    "ERROR": "error",
    "((a))": "a",
    "a OR b OR c d": "a OR b OR (c AND d)",
    "": "",
}
_REFUSED = ["(a OR b", "!!!", "a AND", "OR a", "a AND AND b", "NOT", "()", "a)"]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


@query(f"SELECT query, shown, parses FROM {_values([(k, v, True) for k, v in _SHOWN.items()] + [(k, 'QueryError', False) for k in _REFUSED])} AS v(query, shown, parses)")
def query_display(spark, sf_dir):
    """Queries as they are shown once parsed, and those that are refused."""

    def row(text: str) -> tuple:
        try:
            return text, display(parse_query(text)), True
        except QueryError as e:
            return text, type(e).__name__, False

    return spark.createDataFrame([row(text) for text in [*_SHOWN, *_REFUSED]], "query string, shown string, parses boolean")


@query("""SELECT given, set_default, CASE WHEN given IS NULL THEN set_default WHEN given = 0 THEN NULL ELSE given END AS resolved
  FROM (VALUES (NULL), (0), (1), (5000)) AS g(given), (VALUES (0), (7), (1000)) AS d(set_default)""")
def resolved_limits(spark, sf_dir):
    """The limit that holds for a request: null for none."""
    rows = [(given, default, Settings(search_limit=default).resolve_limit(given)) for given in (None, 0, 1, 5000) for default in (0, 7, 1000)]
    return spark.createDataFrame(rows, "given int, set_default int, resolved int")


_ENV = {"SIEVELOG_BLOCK_ROWS": "0", "SIEVELOG_PACK_ROWS": "12", "SIEVELOG_SEARCH_LIMIT": "x", "SIEVELOG_TCP_FLUSH_MS": "50"}


@query(f"SELECT name, value FROM {_values([('block_rows', 1), ('pack_rows', 12), ('search_limit', 1000), ('tcp_batch_lines', 1000), ('tcp_flush_ms', 50)])} AS v(name, value)")
def settings_from_env(spark, sf_dir):
    """Settings given by the environment; what doesn't parse keeps its default, and blocks have a row at least."""
    return spark.createDataFrame(list(asdict(Settings.from_env(_ENV)).items()), "name string, value int")


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE line <> '' GROUP BY line")
def line_server(spark, sf_dir):
    """The benchmark's lines sent to a TCP listener, stored as they come, and read back."""
    store = _store(spark)
    take = lambda lines: store.append(spark.createDataFrame([(x,) for x in lines], "line string"))
    server = LineServer(take, "tcp")
    try:
        with socket.create_connection(("127.0.0.1", server.port)) as s:
            for r in table(spark, sf_dir, "benchmark").select("text").toLocalIterator():
                s.sendall(r["text"].encode() + b"\n")
            s.shutdown(socket.SHUT_WR)
            s.recv(1)  # nothing comes, once the listener has read all
        for thread in server.threads[1:]:
            thread.join()
    finally:
        server.stop()
    return store.lines().groupBy("line").agg(F.count("*").alias("n"))


# Sources


def _envelopes(spark, sf_dir) -> DataFrame:
    """Event rows as NDJSON of several kinds: each known key, a number under a known key, none, strings, arrays, text."""
    text = F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string"))
    obj = lambda *pairs: F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in pairs)), F.lit("}"))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    kinds = [obj(("message", quoted)), obj(("level", F.lit('"x"')), ("@message", quoted)), obj(("message", F.col("user_id").cast("string")), ("msg", quoted)), obj(("log", quoted), ("text", F.lit('"no"'))), obj(("text", quoted)), F.col("props"), quoted, F.concat(F.lit("["), quoted, F.lit("]")), text, F.concat(obj(("message", quoted)), F.lit(" x"))]
    choice = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", choice.alias("line"))


@query("""SELECT event_id, CASE event_id % 10 WHEN 5 THEN props WHEN 7 THEN '["' || t || '"]' WHEN 9 THEN '{"message":"' || t || '"} x' ELSE t END AS line
  FROM (SELECT event_id, props, event_type || ' by ' || user_id AS t FROM events)""")
def ndjson_normalize(spark, sf_dir):
    """The message of every envelope: built of many kinds, and reduced."""
    prepare(spark)
    return _envelopes(spark, sf_dir).select("event_id", normalize_line("line").alias("line"))


@query("SELECT event_id, CASE WHEN json_valid(props) AND json_type(props) = 'VARCHAR' THEN props ->> '$' ELSE props END AS line FROM events")
def ndjson_passthrough(spark, sf_dir):
    """Objects without a known key stay as they came."""
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", normalize_line("props").alias("line"))


@query(r"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(13) || chr(10) || chr(10)), chr(10)), lambda x: regexp_replace(x, '\r+$', '')), lambda x: x <> '')) AS line FROM documents) GROUP BY ALL""")
def datagram_split(spark, sf_dir):
    """Payloads of many lines, some empty, some ending in a carriage return."""
    payload = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(payload, "UTF-8").alias("payload"))
    lines = docs.select("doc_id", F.explode(split_lines(F.decode("payload", "UTF-8"))).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query("SELECT text AS line, count(*) AS n FROM conversations GROUP BY text")
def array_body_ingest(spark, sf_dir):
    """Conversations as JSON array bodies, and the lines taken from them."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list("text")).alias("body"))
    return from_array_body(turns).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT ingested FROM (SELECT count(*) AS ingested FROM conversations)")
def ingest_count(spark, sf_dir):
    """How many lines an ingest takes in."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    n = store.ingest(table(spark, sf_dir, "conversations"), "text", order=["conv_id", "turn"])
    return store.lines().agg(F.count("*").alias("ingested")).filter(F.col("ingested") == n)


@query("SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE line <> ''")
def datagram_rows(spark, sf_dir):
    return from_datagrams(table(spark, sf_dir, "benchmark").select(F.col("text").alias("payload")))


@query(f"SELECT line, hits FROM (SELECT {_sql_list('p_name')} AS t, p_name AS line FROM part) JOIN (SELECT count(*) AS hits FROM part) ON true WHERE len(t) > 1 AND NOT list_contains(t, 'the')")
def search_parts(spark, sf_dir):
    """A negated search over short lines, beside the number of all."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("line"))
    total = parts.agg(F.count("*").alias("hits"))
    found = parts.filter((F.size(token_list("line")) > 1) & predicate(parse_query("NOT the"), tokens("line")))
    return found.join(F.broadcast(total)).select("line", "hits")


