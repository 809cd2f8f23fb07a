import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from hitlens.llm import host_quality, suffix_dedup  # noqa: E402
from hitlens.llm.store import shared_folder, stage  # noqa: E402

from .helpers import SF001, empty, frame, rows_of  # noqa: E402
from .test_credentials import plain as spans_of  # noqa: E402
from .test_host_quality import verdicts  # noqa: E402
from .test_packing import check as check_packing  # noqa: E402
from .test_simhash_dedup import classes_of, print_of  # noqa: E402
from .test_suffix_dedup import repeated_words  # noqa: E402


def steps(spark, docs):
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF001), name))
    return out


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    start, good, single, cut, masked, packed = steps(spark, docs)
    assert all(x.dtypes == docs.dtypes for x in (good, single, cut, masked))
    texts = [{r.doc_id: r.text for r in x.collect()} for x in (start, good, single, cut, masked)]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in start.collect()]
    assert set(texts[1]) == {r[0] for r, (_, kept) in zip(rows, verdicts(rows)) if kept}
    classes = classes_of({i: print_of(t) for i, t in texts[1].items()})
    assert set(texts[2]) == set(classes.values())
    rows = [(i, t, "", "") for i, t in texts[2].items()]
    repeated = repeated_words(rows, suffix_dedup.HEAD)
    for i, t in texts[2].items():
        if not any(d == i for d, _ in repeated):
            assert texts[3][i] == t
    assert not repeated_words([(i, t, "", "") for i, t in texts[3].items()], suffix_dedup.MIN_WORDS)
    assert set(texts[4]) == set(texts[3])
    for i, t in texts[3].items():
        assert (texts[4][i] == t) == (not spans_of(t)[1])
        assert not spans_of(texts[4][i])[0]
    lengths = {r.doc_id: (r.n_chars, len(r.text)) for r in masked.collect() if r.text != texts[0][r.doc_id]}
    assert lengths and all(a == b for a, b in lengths.values())
    check_packing(packed.collect(), [(i, t) for i, t in texts[4].items()], 0.001)
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SF001)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["secrets"]  # what packing reads
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed.collect())


def test_odd_rows_and_empty_table(spark):
    for docs in (frame(spark), empty(spark)):
        *kept, packed = steps(spark, docs)
        assert all(x.columns == docs.columns for x in kept)
        assert packed.count() == 0 or docs.count()
    long = {r.doc_id for r in kept[-1].collect()}
    assert not long
    assert host_quality.RULES and rows_of()
