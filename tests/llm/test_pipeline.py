import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        from shopstead.llm.common import stored

        out = stored(stage(spark, docs, sf), "t")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= seen, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns, name
        seen, docs = set(ids), out
    assert "ids" in docs.columns and docs.count() > 0


def test_stages_take_awkward_rows(spark, sf):
    """Nulls in every column, blank texts, repeated rows and an empty table pass through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "Some words that are read again.\nAnd a second line of them."
    rows = [(None, text, None, None, None), (1, None, None, "a", None), (2, "", "en", None, 0), (3, " \n", "en", "a", 2), (4, text, "en", "a", 58), (4, text, "en", "a", 58), (5, text + " ", "en", "b", 59), (6, "word " * 3000, "en", "b", 15000)]
    odd = spark.createDataFrame(rows, docs.schema)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        got[name] = [(r.doc_id, getattr(r, "text", None)) for r in stage(spark, odd, sf).collect()]
    assert (None, text) in got["line dedup"] and (4, text) in got["line dedup"] and 5 not in dict(got["line dedup"]) and (3, " \n") in got["line dedup"]
    assert [i for i, _ in got["n-gram Jaccard join"]].count(4) == 2 and 5 not in dict(got["n-gram Jaccard join"]) and None in dict(got["n-gram Jaccard join"])
    assert len(got["byte-level BPE encoding and decoding"]) == len(rows)
    assert {1, 2, 3, None}.isdisjoint(dict(got["mixing sources to target weights"]))


def test_queries_say_what_their_contracts_say(spark):
    """Conversation -7 is read back; BPE digests are those of ids and bytes; op10's digests are those of a plain scan."""
    import hashlib

    from shopstead.llm import queries

    sf = "/root/testdata/sf0.001"
    hard = r"\### Assistant: </turn> ok"
    chat = queries.op7_chat_formatting(spark, sf).where("conv_id = -7").first()
    assert (chat.n_turns, chat.loss_chars, chat.loss_sha256) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())
    assert chat.turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bpe = {r.doc_id: r.decoded_sha256 for r in queries.op1_bpe(spark, sf).collect()}
    assert bpe == {i: hashlib.sha256(t).hexdigest() for i, t in texts.items()}
    seen, want = set(), {}
    for i in sorted(texts):
        data, cover = texts[i], bytearray(len(texts[i]))
        for p in range(len(data) - 99):
            w = hash(data[p : p + 100])
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        want[i] = (len(data), sum(cover), hashlib.sha256(bytes(b for b, c in zip(data, cover) if not c)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, sf).collect()} == want


def test_nothing_is_left_in_the_shared_folder(spark, sf):
    """Operators keep tables while lazy results may read them; cleared() takes them all away."""
    import os

    from shopstead.llm import common, queries

    for name in ("op2_line_dedup", "op6_ngram_jaccard_join", "op8_lm_scoring", "op10_suffix_dedup", "op11_spelling_variants", "op12_decontamination", "op13_prefix_trie"):
        queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    folder = common.shared_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    common.cleared(spark)
    assert not os.path.exists(folder)
