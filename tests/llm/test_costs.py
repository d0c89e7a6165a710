"""What operators must not compute, build or keep twice."""

import tracemalloc

import public_tokenizers
from pyspark.sql import functions as F

from landcompare.llm import linetemplates, sentencepieces, tokencounts


def test_lines_are_masked_once(spark, monkeypatch):
    """The rows are read for the lines and for the result, and not again for the tokens."""
    reads = spark.sparkContext.accumulator(0)

    def counted(text):
        reads.add(1)
        return text

    rows = [(k, f"the line number of all is {k} here\nown words w{k} stand in this line only {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    docs.write.mode("overwrite").saveAsTable("costs_docs")
    docs = spark.table("costs_docs")
    text = F.udf(counted, "string").asNondeterministic()("text")
    found = linetemplates.dropped(docs.select("doc_id", text.alias("text")), min_docs=2).collect()
    spark.sql("DROP TABLE costs_docs")
    assert {r.some_id for r in found} and reads.value == len(rows)


def rows_shuffled(plan):
    """Rows written to the shuffles of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_shuffled(plan.executedPlan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return own + sum(map(rows_shuffled, below))


def test_lines_alone_in_their_leaf_do_not_move(spark, monkeypatch):
    """Only masked lines that are taken apart into tokens are dealt, not those of all texts."""
    moved, plain = {}, linetemplates.stored

    def noted(frame, name, *more):
        if name == "line-tokens":
            frame.collect()
            moved[name] = rows_shuffled(frame._jdf.queryExecution().executedPlan())
        return plain(frame, name, *more)

    monkeypatch.setattr(linetemplates, "stored", noted)
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(k, f"{word} line of a leaf alone\nlines of one leaf share all but {word}") for k in range(1000) for word in [str(k).translate(letters)]]
    rows = [(k, text if k < 20 else text.split("\n")[0]) for k, text in rows]
    found = linetemplates.dropped(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert sorted((r.some_id, *r.drops) for r in found) == [(k, 1) for k in range(1, 20)]
    assert 20 <= moved["line-tokens"] < 100


def test_sifted_rows_hold_all_keys(spark, monkeypatch):
    """At the ends of bitmaps and numbers too, and where there are too many keys for the bitmaps."""
    ends = [0, -1, 1, 7, 8, (1 << 15) - 1, 1 << 15, (1 << 26) - 1, 1 << 26, (1 << 63) - 1, -(1 << 63)]
    ends = spark.createDataFrame([(x,) for x in ends], "place BIGINT")
    assert linetemplates.sifted(ends, ends, "place").count() == 11 and linetemplates.sifted(ends, ends.limit(0), "place").count() == 0
    rows = spark.range(100_000).select(F.xxhash64("id").alias("place"), "id")
    few, many = rows.where("id % 100 = 0").select("place"), rows.where("id % 2 = 0").select("place")
    assert 1000 <= linetemplates.sifted(rows, few, "place").count() < 1050
    monkeypatch.setattr(linetemplates, "BITMAPS", 1)
    found = linetemplates.sifted(rows, many, "place")
    assert found.join(many, "place", "left_semi").count() == 50_000 and found.count() == found.select("id").distinct().count()


def test_remembered_words_are_bounded_with_their_entries(monkeypatch):
    monkeypatch.setattr(tokencounts, "MEMO_BYTES", 1 << 20)
    with open(public_tokenizers.path(tokencounts.TOKENIZER)) as file:
        count = tokencounts.word_counter(file.read())
    want = count(["w1 w2", "w1", ""])
    tracemalloc.start()
    for k in range(0, 60_000, 500):
        count([f"w{n}" for n in range(k, k + 500)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 3 << 20
    assert count(["w1 w2", "w1", ""]) == want


def test_texts_to_encode_come_in_small_batches(spark, monkeypatch, tmp_path):
    seen, plain = [], tokencounts.small_batches

    def noted(session, *rows):
        seen.append(rows)
        return plain(session, *rows)

    monkeypatch.setattr(tokencounts, "small_batches", noted, raising=True)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(700)], "doc_id BIGINT, text STRING")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = tokencounts.count_tokens(docs, public_tokenizers.path(tokencounts.TOKENIZER), str(tmp_path))
    assert found.count() == 700 and len(seen) == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def model():
    with open(public_tokenizers.path(sentencepieces.MODEL), "rb") as file:
        return file.read()


def test_one_codec_for_all_tasks_of_a_worker():
    data = model()
    assert sentencepieces.codec_of(data) is sentencepieces.codec_of(bytes(bytearray(data)))


def test_lost_words_are_found_one_by_one(monkeypatch):
    """A word that is not decoded to itself spoils only its own texts."""
    codec = sentencepieces.Codec(model())
    plain = codec._decoded
    odd = codec._ids(["\u2581words"])[0]

    def wrong(ids):
        return [t.replace("words", "w") if bytes(sentencepieces.packed(odd)) in sentencepieces.packed(list(i)) else t for i, t in zip(ids, plain(ids), strict=True)]

    monkeypatch.setattr(codec, "_decoded", wrong)
    found = codec.encode(["some words here", "some more here", "words", "here"])
    assert [r[2] for r in found] == [False, True, False, True] and codec.lost == {"\u2581words"}


def test_one_counter_for_all_tasks_of_a_worker():
    with open(public_tokenizers.path(tokencounts.TOKENIZER)) as file:
        content = file.read()
    assert tokencounts.counter_of(content) is tokencounts.counter_of(content)


def test_worker_keeps_no_words_after_a_task(monkeypatch):
    """Python workers outlive their tasks, so the words of one would weigh on the next operator's memory."""
    import public_tokenizers
    import pyarrow as pa

    from landcompare.llm import common, sentencepieces

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    class Docs:
        class sparkSession:
            class conf:
                get = staticmethod(lambda name, default: default)

            class sparkContext:
                broadcast = staticmethod(lambda data: type("Shared", (), {"value": data}))

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    monkeypatch.setattr(sentencepieces, "texts", lambda docs: Rows())
    path = public_tokenizers.path(sentencepieces.MODEL)
    run = sentencepieces.encode(Docs, path)
    batch = pa.record_batch([pa.array(range(500)), pa.array([f"some words {k}" for k in range(500)])], ["doc_id", "text"])
    found = list(run(iter([batch])))
    assert sum(b.num_rows for b in found) == 500 and all(b.num_rows <= common.TEXTS for b in found)
    with open(path, "rb") as file:
        assert not sentencepieces.codec_of(file.read()).memo
    assert given == [1]
