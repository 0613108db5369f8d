"""The registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ENTITIES, HIDDEN, TITLE, tokens
from lodestone.operators import answers, feedback, inverted, questions, ranking, sentences, temporal, terms
from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.terms import Index
from lodestone.plans.graph import END, StageGraph
from lodestone.settings import Settings
from lodestone.sources.shared import shared_path
from lodestone.sources.tables import stream, table
from lodestone.streaming.incremental import SegmentedIndex

S = Settings()


def configure(settings: Settings) -> None:
    """The settings of all queries from here on; they are read when a query is
    planned."""
    global S
    S = settings


def _docs(spark, d) -> DataFrame:
    return terms.spread(table(spark, d, "documents").select("doc_id", "text"))


def _index(spark, d) -> Index:
    return Index(_docs(spark, d))


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("input"))


def _bm25_hits(index, spark, d) -> DataFrame:
    return ranking.bm25(index, _questions(spark, d), S.k, S.k1, S.b)


def tokenize_docs(spark, d):
    return terms.tokenize_docs(table(spark, d, "documents")).select("doc_id", "dl")


def term_stats(spark, d):
    return terms.term_stats(_docs(spark, d))


def chunk_docs(spark, d):
    return terms.chunk_docs(_docs(spark, d), S.chunk, S.stride)


def bm25_topk(spark, d):
    return _bm25_hits(_index(spark, d), spark, d)


def tfidf_cosine_topk(spark, d):
    return ranking.tfidf_cosine(_index(spark, d), _questions(spark, d), S.k)


def dense_knn(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ranking.dense_knn(vectors, vectors.filter("vec_id % 50 = 0"), S.neighbours)


def rrf_fusion(spark, d):
    index = _index(spark, d)
    return ranking.rrf(_bm25_hits(index, spark, d), ranking.tfidf_cosine(index, _questions(spark, d), S.k), k=S.k, constant=S.fusion)


def mmr_rerank(spark, d):
    index = _index(spark, d)
    return ranking.mmr(_bm25_hits(index, spark, d), index, S.picks, S.trade)


def grade_filter(spark, d):
    return answers.grade_filter(bm25_topk(spark, d), table(spark, d, "labels"))


def dedup_exact(spark, d):
    return answers.dedup_exact(table(spark, d, "documents"))


def _packed(spark, d) -> DataFrame:
    index = _index(spark, d)
    return answers.context_pack(_bm25_hits(index, spark, d), index, S.budget)


def context_pack(spark, d):
    return _packed(spark, d)


def chat_history(spark, d):
    return answers.chat_history(table(spark, d, "conversations"))


def route_turn(spark, d):
    return answers.route_turn(table(spark, d, "conversations"), S.long_turn)


def build_prompt(spark, d):
    return answers.build_prompt(_packed(spark, d), table(spark, d, "documents"), _questions(spark, d))


def extractive_answer(spark, d):
    return answers.extractive_answer(_docs(spark, d), _questions(spark, d), S.chunk, S.stride)


def qrels(spark, d):
    return answers.qrels(_docs(spark, d), table(spark, d, "benchmark"))


def retrieval_eval(spark, d):
    return answers.retrieval_eval(bm25_topk(spark, d), qrels(spark, d), S.k)


def html_to_text(spark, d):
    return answers.html_to_text(table(spark, d, "pages"))


def graph_run(spark, d):
    """The reference flow as a graph: route each turn, retrieve for user turns,
    end the others. State: one row a turn with its node and best document."""
    turns = table(spark, d, "conversations")
    asking = turns.filter(answers.next_node(S.long_turn).isin("retrieve", "summarize"))
    best_of = questions.over_documents(_docs(spark, d), asking.select(F.explode(tokens(F.col("text"))).alias("term")))

    def route(state):
        return state.withColumn("node", answers.next_node(S.long_turn))

    def summarize(state):
        return state.withColumn("text", F.array_join(F.array_distinct(tokens(F.col("text"))), " "))

    def retrieve(state):
        asked = state.select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("input"))
        best = best_of(asked).select(F.col("qid").alias("asked"), F.col("doc_id").alias("best_doc"))
        return state.join(best, F.struct("conv_id", "turn").eqNullSafe(F.col("asked")), "left").drop("asked")

    graph = StageGraph().add_node("route", route).add_node("summarize", summarize).add_node("retrieve", retrieve)
    graph.add_condition("route", F.col("node"), {"retrieve", "summarize", END}).add_edge("summarize", "retrieve").add_edge("retrieve", END)
    return graph.compile()(turns).select("conv_id", "turn", "node", "best_doc")


def _inverted(spark, d) -> InvertedIndex:
    return InvertedIndex.build(_docs(spark, d))


def _some_words(spark, d, places) -> DataFrame:
    """Questions of the words at these places of each benchmark text."""
    words = tokens(F.col("text"))
    picked = F.array_compact(F.array(*[F.get(words, F.lit(p)) for p in places]))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(picked, " ").alias("input"))


def phrase_search(spark, d):
    """Where the first three words of each benchmark text follow one another."""
    return inverted.phrases(_inverted(spark, d), _some_words(spark, d, (0, 1, 2)))


def proximity_search(spark, d):
    """Where three words of each benchmark text are near one another."""
    return inverted.proximity(_inverted(spark, d), _some_words(spark, d, (0, 2, 4)), S.window)


def bm25_pruned(spark, d):
    return inverted.bm25_pruned(_inverted(spark, d), _questions(spark, d), S.k, S.k1, S.b)


def rm3_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return feedback.rm3(_inverted(spark, d), docs, _questions(spark, d), S.k, S.feedback, S.expansion, S.own, S.k1, S.b)


def _asked_turns(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("input"))


def corrective_loop(spark, d):
    """User turns through retrieve, grade and rewrite until each has ended."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = InvertedIndex.build(_docs(spark, d), positions=False)
    return feedback.corrected(index, docs, _asked_turns(spark, d), S.enough, S.retrievals)


def near_spellings(spark, d):
    """Words of the conversations that no document holds, and what may be meant."""
    words = table(spark, d, "conversations").select(F.explode(tokens(F.col("text"))).alias("word"))
    return feedback.near_spellings(terms.term_stats(_docs(spark, d)), words, S.edits, S.spellings)


def merged_passages(spark, d):
    """The ten best passages of each question, joined where they overlap."""
    docs = _docs(spark, d)
    hits = answers.best_passages(docs, _questions(spark, d), S.k, S.chunk, S.stride)
    return feedback.merged_spans(hits, docs, S.chunk, S.stride)


def sentence_answer(spark, d):
    """Three central sentences of the best documents of each question."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sentences.central_sentences(_bm25_hits(_index(spark, d), spark, d), docs, _questions(spark, d))


def asof_events(spark, d):
    """Each purchase with the latest click of its user before it."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return temporal.asof_join(bought, clicks, "user_id", "ts", ["click_id", "click_value"]).select("event_id", "user_id", "value", "click_id", "click_value")


def interval_events(spark, d):
    """Purchases within ten minutes from each error on, of whatever user."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").select("event_id", micros.alias("at"), "event_type", "value")
    opened = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("start"), (F.col("at") + 600_000_000).alias("stop"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "at", "value")
    met = temporal.interval_join(opened, bought, "start", "stop", "at")
    return met.groupBy("error_id").agg(F.count("*").alias("purchases"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 4).alias("total"))


def event_sessions(spark, d):
    """Each user's sessions, which half a day without an event ends."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").select("user_id", micros.alias("at"), "value")
    made = temporal.sessions(events, "user_id", "at", S.pause * 1_000_000, [F.round(F.sum("value"), 4).alias("total")])
    return made.select("user_id", F.col("start").alias("start_us"), F.col("stop").alias("stop_us"), "n", "total")


def streamed_bm25(spark, d):
    """BM25 on an index that two streams have filled: the documents, and the
    withdrawals of those that are labelled toxic."""
    index = SegmentedIndex(spark)
    added = stream(spark, d, "documents", S.files_at_once).select("doc_id", "text", F.lit(0).alias("version"), F.lit(False).alias("deleted"))
    gone = stream(spark, d, "labels", S.files_at_once).filter("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("version"), F.lit(True).alias("deleted"))
    for changes in (gone, added):
        index.follow(changes, shared_path(spark, "stream"), availableNow=True).awaitTermination()
    index.compact()
    return ranking.bm25(index.open(), _questions(spark, d), S.k, S.k1, S.b)


_QUERIES = [
    tokenize_docs, term_stats, chunk_docs, bm25_topk, tfidf_cosine_topk, dense_knn, rrf_fusion, mmr_rerank, grade_filter, dedup_exact,
    context_pack, chat_history, route_turn, build_prompt, extractive_answer, qrels, retrieval_eval, html_to_text, graph_run,
    phrase_search, proximity_search, bm25_pruned, rm3_topk, corrective_loop, near_spellings, merged_passages, sentence_answer, asof_events, interval_events,
    event_sessions, streamed_bm25,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25(docs: str, queries: str, k: int, doc: str = "doc_id") -> str:
    """Common table expressions that end in `hits`."""
    return f"""
toks AS (SELECT {doc}, {_TOK.format("text")} AS w FROM {docs}),
whole AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
tf AS (SELECT {doc}, dl, term, count(*) AS tf FROM (SELECT {doc}, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT qid, unnest({_TOK.format("input")}) AS term FROM {queries}),
sc AS (SELECT qid, {doc}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN qt USING (term), whole GROUP BY qid, {doc}),
hits AS (SELECT qid, {doc}, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {doc}) AS rk FROM sc QUALIFY rk <= {k})"""


_Q = "q AS (SELECT item_id AS qid, text AS input FROM benchmark)"
_BM25 = f"{_Q}, {_bm25('documents', 'q', 10)}"
_TFIDF = f"""
tn AS (SELECT count(*) AS n FROM documents),
tp AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS term FROM documents) GROUP BY ALL),
ti AS (SELECT term, ln(1 + n / count(*)) AS idf FROM tp, tn GROUP BY term, n),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS dw FROM tp JOIN ti USING (term)),
dn AS (SELECT doc_id, sqrt(sum(dw * dw)) AS dn FROM dw GROUP BY doc_id),
tq AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_TOK.format("input")}) AS term FROM q) GROUP BY ALL),
qw AS (SELECT qid, term, (1 + ln(tf)) * idf AS qw FROM tq JOIN ti USING (term)),
qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY qid),
ts AS (SELECT qid, doc_id, round(sum(dw * qw) / (any_value(dn) * any_value(qn)), 6) AS score
       FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (qid) GROUP BY qid, doc_id),
th AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM ts QUALIFY rk <= 10)"""
_PACKED = f"""
pk AS (SELECT qid, doc_id, rk, len(w)::BIGINT AS n_tok, (sum(len(w)) OVER (PARTITION BY qid ORDER BY rk ROWS UNBOUNDED PRECEDING))::BIGINT AS used
       FROM hits JOIN toks USING (doc_id)),
packed AS (SELECT * FROM pk WHERE used <= 2000)"""
_CHUNKS = f"""
ct AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents),
ci AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 64) / 48.0))::BIGINT + 1)) AS chunk_ix FROM ct WHERE len(w) > 0),
chunks AS (SELECT doc_id, chunk_ix, array_to_string(w[chunk_ix * 48 + 1:chunk_ix * 48 + 64], ' ') AS chunk FROM ci)"""
_WORDS = "{}(qid, p) AS (SELECT item_id, list_filter([{}], lambda x: x IS NOT NULL) FROM (SELECT item_id, {} AS w FROM benchmark))"
_PHRASES = _WORDS.format("p", "w[1], w[2], w[3]", _TOK.format("text"))
_NEAR = _WORDS.format("p", "w[1], w[3], w[5]", _TOK.format("text"))
_POSITIONS = f"""
t AS (SELECT doc_id, {_TOK.format("text")} AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM t)"""
# the second pass over the terms of the first one's hits
_RM3 = f"""
own AS (SELECT qid, term, 0.5::DOUBLE * count(*) / (sum(count(*)) OVER (PARTITION BY qid)) AS weight FROM (SELECT qid, unnest({_TOK.format("input")}) AS term FROM q) GROUP BY qid, term),
sh AS (SELECT qid, doc_id, score / (sum(score) OVER (PARTITION BY qid)) AS share FROM hits),
rm AS (SELECT qid, term, round(sum(share * tf / dl), 10) AS p FROM sh JOIN tf USING (doc_id) GROUP BY qid, term),
rb AS (SELECT * FROM rm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY p DESC, term) <= 10),
ew AS (SELECT qid, term, sum(weight) AS weight FROM (SELECT * FROM own UNION ALL SELECT qid, term, 0.5::DOUBLE * p / (sum(p) OVER (PARTITION BY qid)) FROM rb) GROUP BY qid, term),
es AS (SELECT qid, doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN ew USING (term), whole GROUP BY qid, doc_id)"""
_QRELS = "rel AS (SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_NODE = "CASE WHEN role = 'system' THEN 'configure' WHEN role = 'assistant' THEN 'archive' WHEN length(text) > 400 THEN 'summarize' ELSE 'retrieve' END"
def _duck_decoded(text: str) -> str:
    for name, char in ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, *(x.replace("'", "''") for x in (name, char)))
    return text


_BODY = rf"""trim(regexp_replace({_duck_decoded(f"regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '[ \t\n\r]+', ' ', 'g'), ' ')"""
_TITLE = _duck_decoded(f"regexp_extract(html, '{TITLE}', 1)")


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_docs": f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS dl FROM documents",
        "term_stats": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term",
        "chunk_docs": f"WITH {_CHUNKS} SELECT * FROM chunks",
        "bm25_topk": f"WITH {_BM25} SELECT * FROM hits",
        "tfidf_cosine_topk": f"WITH {_Q}, {_TFIDF} SELECT * FROM th",
        "dense_knn": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT a.vec_id AS qid, b.vec_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rk FROM s QUALIFY rk <= 5""",
        "rrf_fusion": f"""
WITH {_BM25}, {_TFIDF},
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rk)), 8) AS score FROM (SELECT qid, doc_id, rk FROM hits UNION ALL SELECT qid, doc_id, rk FROM th) GROUP BY qid, doc_id)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM f QUALIFY rk <= 10""",
        "grade_filter": f"WITH {_BM25} SELECT h.* FROM hits h LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0",
        "dedup_exact": "SELECT md5(lower(trim(text))) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "context_pack": f"WITH {_BM25}, {_PACKED} SELECT * FROM packed",
        "chat_history": """
SELECT conv_id, turn, concat_ws(chr(10), lag(role || ': ' || text, 2) OVER w, lag(role || ': ' || text) OVER w, role || ': ' || text) AS history
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
        "route_turn": f"SELECT conv_id, turn, {_NODE} AS node FROM conversations",
        "build_prompt": f"""
WITH {_BM25}, {_PACKED},
cx AS (SELECT qid, string_agg('[' || rk || '] ' || text, chr(10) ORDER BY rk) AS context FROM packed JOIN documents USING (doc_id) GROUP BY qid)
SELECT qid, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || input AS prompt FROM q LEFT JOIN cx USING (qid)""",
        "extractive_answer": f"""
WITH {_Q}, {_CHUNKS}, keyed AS (SELECT printf('%015d', doc_id) || '/' || printf('%09d', chunk_ix) AS key, chunk AS text FROM chunks),
{_bm25("keyed", "q", 1, "key")}
SELECT qid, split_part(key, '/', 1)::BIGINT AS doc_id, split_part(key, '/', 2)::BIGINT AS chunk_ix, text AS answer FROM hits JOIN keyed USING (key)""",
        "phrase_search": f"""
WITH {_PHRASES}, t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM (SELECT doc_id, {_TOK.format("text")} AS w FROM documents)),
pp AS (SELECT qid, p, ' ' || array_to_string(p, ' ') || ' ' AS s FROM p WHERE len(p) > 0),
held AS MATERIALIZED (SELECT qid, doc_id, w, p FROM t JOIN pp ON contains(t.s, pp.s)),
h AS (SELECT qid, doc_id, list_filter(range(len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p) AS h FROM held)
SELECT qid, doc_id, len(h)::BIGINT AS hits, h[1] AS first FROM h WHERE len(h) > 0""",
        "proximity_search": f"""
WITH {_NEAR}, {_POSITIONS},
qt AS (SELECT DISTINCT qid, unnest(p) AS term FROM p),
s AS (SELECT q.qid, a.doc_id, a.p, o.term, min(b.p) AS nearest FROM qt q JOIN pos a ON a.term = q.term JOIN qt o ON o.qid = q.qid
      JOIN pos b ON b.doc_id = a.doc_id AND b.term = o.term AND b.p BETWEEN a.p AND a.p + 7 GROUP BY ALL),
e AS (SELECT qid, doc_id, p, max(nearest) - p + 1 AS span FROM s GROUP BY qid, doc_id, p HAVING count(*) = (SELECT count(*) FROM qt WHERE qt.qid = s.qid))
SELECT qid, doc_id, span, p AS first FROM e WHERE span <= 8 QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY span, p) = 1""",
        "bm25_pruned": f"WITH {_BM25} SELECT * FROM hits",
        "streamed_bm25": f"""
WITH {_Q}, kept AS (SELECT doc_id, arg_max(coalesce(text, ''), md5(coalesce(text, ''))) AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) GROUP BY doc_id),
{_bm25("kept", "q", 10)}
SELECT * FROM hits""",
        "rm3_topk": f"WITH {_BM25}, {_RM3} SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM es QUALIFY rk <= 10",
        "merged_passages": f"""
WITH {_Q}, {_CHUNKS}, keyed AS (SELECT printf('%015d', doc_id) || '/' || printf('%09d', chunk_ix) AS key, chunk AS text FROM chunks),
{_bm25("keyed", "q", 10, "key")},
ch AS (SELECT qid, score, split_part(key, '/', 1)::BIGINT AS doc_id, split_part(key, '/', 2)::BIGINT AS ix FROM hits),
mk AS (SELECT *, CASE WHEN ix * 48 <= lag(ix) OVER w * 48 + 64 THEN 0 ELSE 1 END AS b FROM ch WINDOW w AS (PARTITION BY qid, doc_id ORDER BY ix)),
il AS (SELECT *, sum(b) OVER (PARTITION BY qid, doc_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS island FROM mk),
sp AS (SELECT qid, doc_id, min(ix) * 48 AS start, max(ix) * 48 + 64 AS stop, max(score) AS score, count(*) AS passages FROM il GROUP BY qid, doc_id, island)
SELECT qid, doc_id, start, least(stop, len(w)) AS stop, score, passages, array_to_string(w[start + 1:least(stop, len(w))], ' ') AS span FROM sp JOIN ct USING (doc_id)""",
        "asof_events": """
WITH c AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, p.value, c.click_id, c.click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""",
        "interval_events": """
SELECT e.event_id AS error_id, count(*) AS purchases, min(p.event_id) AS first_id, round(sum(p.value), 4) AS total
FROM events e JOIN events p ON e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts >= e.ts AND p.ts < e.ts + INTERVAL 10 MINUTE GROUP BY e.event_id""",
        "event_sessions": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 43200000000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(t) AS start_us, max(t) AS stop_us, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""",
        "qrels": f"WITH {_QRELS} SELECT * FROM rel",
        "retrieval_eval": f"""
WITH {_BM25}, {_QRELS},
p AS (SELECT r.qid, min(rk) AS best, count(rk) AS found, count(*) AS wanted FROM rel r LEFT JOIN hits h ON r.qid = h.qid AND r.doc_id = h.doc_id GROUP BY r.qid)
SELECT count(*) AS n_queries, round(avg(CASE WHEN best IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr,
       round(avg(found::DOUBLE / least(wanted, 10)), 6) AS recall_at_k FROM p""",
        "html_to_text": f"SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages",
        "graph_run": f"""
WITH t AS (SELECT conv_id, turn, text, {_NODE} AS node FROM conversations),
q AS (SELECT {{'conv_id': conv_id, 'turn': turn}} AS qid, text AS input FROM t WHERE node IN ('retrieve', 'summarize')),
{_bm25("documents", "q", 1)}
SELECT conv_id, turn, node, doc_id AS best_doc FROM t LEFT JOIN hits ON hits.qid.conv_id = t.conv_id AND hits.qid.turn = t.turn""",
    }
