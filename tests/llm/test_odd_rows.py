"""Every operator over clashing names, repeated identifiers, nulls, empty and very long texts."""

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")

from strandline.llm import exact_dedup, html_crf, license_templates, mixing, ogg, pipeline, queries, sentencepiece_codec, settings, simhash, token_counts, toxicity, warc  # noqa: E402

LONG = " ".join(f"word{i % 5000} plain" for i in range(80_000))  # over a megabyte
NAMES = "__text __copies __order __copy __toxic __id __p_toxic __rn __s doc t i id label shard fp keys keep_id kept first size hash lead rn copies copy order row same class least root path ordinal ids spans media feature labels score n_words".split()
ROWS = [(1, "plain words here"), (1, "plain words here"), (1, "another text"), (None, "plain words here"), (None, None), (2, None), (3, ""), (4, LONG), (5, LONG + " tail"), (6, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    fields = ", ".join(f"`{c}` string" for c in NAMES)
    rows = [(i, t, "s" if i else None, f"<p>{t}</p>" if t else t, *[f"{c}!" for c in NAMES]) for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, html string, {fields}").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "doc_id long, toxic int")


def carried(out, docs):
    """All other columns came along as they were."""
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.select(*[f"`{c}`" for c in NAMES]).collect():
        assert tuple(r) == tuple(f"{c}!" for c in NAMES)


def test_operators_that_carry_columns(spark, docs, labels):
    out = exact_dedup.exact_distinct(docs)
    carried(out, docs)
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == [(1, "ano"), (1, "pla"), (2, ""), (4, "wor"), (5, "wor")]
    out = simhash.near_distinct(docs)
    carried(out, docs)
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == [(1, "ano"), (1, "pla"), (2, ""), (4, "wor")]
    out = mixing.mix_sources(docs, exponent=1.0, size=40)
    carried(out, docs)
    assert out.columns[len(docs.columns) :] == ["__copy_", "__copies_", "__order_"]
    assert mixing.mix_sources(docs, extra=False).columns == docs.columns
    for chain in (None, toxicity.train(docs, labels)):
        out = toxicity.score(docs, chain)
        carried(out, docs)
        assert out.columns[-2:] == ["__p_toxic_", "__toxic_"] and out.count() == len(ROWS)
        carried(toxicity.clean(docs, chain), docs)


def test_operators_that_return_their_own(spark, docs):
    n = len(ROWS)
    assert exact_dedup.exact_groups(docs).count() == n
    groups = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert (6, 4) in groups and (3, 2) in groups and (None, 1) in groups
    assert {(r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()} == {(1, 1), (None, 1), (None, 2), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4)}
    model = settings.tokenizer_path("piece_bpe_32k.model")
    assert all(r.tiled for r in sentencepiece_codec.encode_digests(docs, model).collect())
    assert sentencepiece_codec.encode_texts(docs, model).count() == n
    got = {(r.doc_id, r.n_bytes) for r in ogg.load(ogg.store(docs)).collect()}
    assert got == {(i, len((t or "").encode())) for i, t in ROWS}
    import public_tokenizers

    counted = token_counts.token_counts(docs, settings.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, settings.END_OF_DOCUMENT).collect()
    assert len(counted) == n and {r.n_tokens for r in counted if r.doc_id in (2, 3)} == {0}
    assert sorted(r.n_words for r in license_templates.scan_licenses(docs).collect()) == sorted(len((t or "").split()) for _, t in ROWS)
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("source", "url")
    assert {(r.page_id, r.text) for r in html_crf.extract_main_text(pages).collect()} >= {(5, LONG + " tail"), (2, ""), (3, "")}
    records = warc.read_records(warc.write_archives(pages)).collect()
    assert sorted(r.payload_bytes for r in records) == sorted(len((f"<p>{t}</p>" if t else t) or "") for _, t in ROWS)


def test_operators_take_empty_tables(spark, docs, labels):
    none = docs.where("false")
    pages = none.withColumnRenamed("doc_id", "page_id").withColumnRenamed("source", "url")
    model = settings.tokenizer_path("piece_bpe_32k.model")
    outs = [exact_dedup.exact_groups(none), exact_dedup.exact_distinct(none), simhash.near_groups(none), simhash.near_distinct(none), mixing.mix_sources(none), toxicity.score(none, toxicity.train(none, labels)), ogg.load(ogg.store(none))]
    outs += [sentencepiece_codec.encode_digests(none, model), license_templates.scan_licenses(none), html_crf.extract_main_text(pages), warc.read_records(warc.write_archives(pages))]
    assert all(out.collect() == [] for out in outs)


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns
            carried(out, docs)
        pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert set(queries.queries()) >= {"pipeline"}
