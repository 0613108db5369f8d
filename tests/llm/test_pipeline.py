import collections
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import test_mixing
import test_simhash
from lodestone.llm import graphs, mixing, packing, pii, quality


def test_stages_are_those_of_the_plan():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixture", "sequences"]


def test_each_stage_and_the_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, tables = [docs.count()], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tables[-1], sf).cache()
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        tables.append(out)
        counts.append(out.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    for r in tables[3].collect():
        assert not any(k in pii.BASE_KINDS for k, *_ in pii.find_spans(r.text)) and r.n_chars == len(r.text)
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = collections.Counter(r.doc_id for r in tables[4].collect())
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == kept
    used = collections.defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 2


def test_rows_equal_a_plain_version(spark, sf):
    """The rules by SQL; near-duplicates by every pair's similarity; personal
    data by the function that its own tests compare with plain patterns; the
    mixture by sorting whole leaves; ids by the tokenizers library. Which
    sequence a piece is in is free, so sequences are tested to be gapless."""
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    verdicts = base.execute(quality.oracle_op7()).fetch_df()
    clean = set(verdicts["doc_id"][verdicts["kept"]])
    rows = [r for r in base.execute("select doc_id, text, lang, source from documents").fetchall() if r[0] in clean]
    kept = set(test_simhash.kept_by_brute_force([r[:2] for r in rows])[0])
    rows = [(i, pii.masked(t, pii.find_spans(t)), lang, source) for i, t, lang, source in rows if i in kept]
    assert 0 < len(rows) < len(clean) < len(verdicts)
    chosen = test_mixing.brute(rows, mixing.TREE, mixing.SHARE, mixing.EPOCHS, mixing.SEED)
    texts, plain, want = {r[0]: r[1] for r in rows}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, _ in chosen:
        ids = plain.encode(texts[i], add_special_tokens=False).ids + [0]
        want.update((i, n, at, tuple(ids[at : at + size])) for n, (at, size) in enumerate(packing.cut(len(ids), 2048)))

    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_tables_are_few_files_and_batches_are_small(spark, sf, monkeypatch):
    files, plain = [], graphs.written

    def told(*args):
        out = plain(*args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graphs, "written", told)
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        texts = [" ".join(f"w{i // 2}x{k}" for k in range(40)) + f" end{i}" for i in range(400)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        assert corpus_pipeline.near_duplicates(spark, docs, sf).count() == 200
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        assert files and max(files) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
