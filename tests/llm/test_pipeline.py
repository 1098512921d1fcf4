import corpus_pipeline
import pytest
from folium.llm.common import read
from folium.session import stored
from helpers import ODD, documents, prose
from test_jaccard_join import brute

FOLDER = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs, sizes = read(spark, FOLDER, "documents"), []
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, FOLDER))
        sizes.append(docs.count())
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= was
        if name.startswith("n-gram"):
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert ids == {i for i, (_, c) in brute(rows).items() if i == c}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] == sizes[-2]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("rows", [[], [*ODD, (None, prose(1, 50)), (3, prose(1, 50))]])
def test_stages_on_odd_documents(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("labels", "benchmark"):
        read(spark, FOLDER, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == (2 if rows else 0)
