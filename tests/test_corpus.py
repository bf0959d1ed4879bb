"""A corpus from its folder to answers, twice."""

from quillspark.operators.embedding import HashedWords
from quillspark.plans.corpus import Corpus


def test_corpus_is_built_asked_and_kept_up_to_date(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, text: (tmp_path / f"in/{name}.txt").write_text(text)
    put("13.1 - Commercial Code", "## head\n1. A trader means a person who trades.\n2. The penalty is a fine.\n")
    put("55.09 - Ethics", "1. Notaries shall be honest.\n2. A notary keeps a register.\n")
    put("79 - Nothing", "no article here\n")
    corpus = Corpus(spark, str(tmp_path / "corpus"), HashedWords(16), approximate=True, size=100, overlap=10)
    assert corpus.build(str(tmp_path / "in")) == {"kept": 0, "removed": 0, "embedded": 4, "failed": 0}
    assert {(r["file"], r["articles"], r["total_documents"]) for r in corpus.report().collect()} == {("13.1 - Commercial Code", 2, 3), ("55.09 - Ethics", 2, 3), ("79 - Nothing", 0, 3)}
    queries = spark.createDataFrame([(1, "what is a trader"), (2, "Article 2 of the Commercial Code"), (3, "who keeps a register")], "query_id long, query string")
    hits = corpus.search(queries, threshold=0.0, log="first").collect()
    corpus.search(queries, threshold=0.0, log="first")
    assert [h["citation"] for h in hits if h["query_id"] == 2] == ["Commercial Code (Cap. 13) Art. 2"] or [h["citation"] for h in hits if h["query_id"] == 2] == ["Commercial Code (Cap. 13) Reg. 2"]
    assert any("trader" in h["content"] for h in hits if h["query_id"] == 1) and any("register" in h["content"] for h in hits if h["query_id"] == 3)
    answers = {r["query_id"]: r for r in corpus.ask(queries, threshold=0.0).collect()}
    assert set(answers) == {1, 3} and all(r["citations"] for r in answers.values())
    assert corpus.logged().count() == 3 and {r["message"]: r["n"] for r in corpus.frequent().collect()}["what is a trader"] == 1
    asks = spark.createDataFrame([(1, "1", None)], "query_id int, article_num string, doc_hint string")
    assert [r["doc_code"] for r in corpus.article(asks).collect()] == ["code_13"]
    # one file changes, one goes, one comes: only what differs is embedded
    put("13.1 - Commercial Code", "1. A trader means a person who trades.\n2. The penalty is prison.\n")
    put("604.1 - Leases", "1. A lease is written.\n")
    (tmp_path / "in/55.09 - Ethics.txt").unlink()
    assert corpus.build(str(tmp_path / "in")) == {"kept": 1, "removed": 3, "embedded": 2, "failed": 0}
    again = corpus.search(queries, threshold=0.0).collect()
    assert not any("register" in h["content"] for h in again) and any("prison" in h["content"] for h in again)
    assert corpus.build(str(tmp_path / "in")) == {"kept": 3, "removed": 0, "embedded": 0, "failed": 0}
