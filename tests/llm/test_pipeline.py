import os
import random
import string

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, now, SF)
        assert following.columns == docs.columns, name
        rows = following.collect()
        assert {r.doc_id for r in rows} <= set(texts) and len(rows) > 0.8 * len(texts)
        assert all(r.n_chars == len(r.text) for r in rows) or name == "language_id"
        now = following
    done = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert done.where("not round_trip").count() == 0 and done.count() == now.count()


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_language_stage_rejects_what_is_no_known_language(spark):
    """Foreign text in Latin letters, random letters, hexadecimal and base64 go; documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(3)
    noise = [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 10))) for _ in range(200)) for letters in (string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits + "+/")]
    odd = [(10**9 + k, t, None, None, len(t)) for k, t in enumerate([*FOREIGN, *noise])]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), "").select("doc_id").collect()}
    assert not [t for i, t, *_ in odd if i in kept]
    with_letters = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert kept == with_letters


def test_one_row_of_each_component_stays(spark):
    """Rows without an id, and repeated rows, are no exception."""
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in ("a", "b"))
    rows = [(None, a), (None, a), (7, a), (7, a), (3, a), (3, a), (None, b), (None, b), (None, b), (None, None), (None, ""), (9, "other words than those"), (9, b + " " + a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(3, a), (0, b), (0, ""), (9, "other words than those"), (9, b + " " + a)])


def test_lines_are_put_together_once(spark):
    """No filter of the line stage splits and joins the texts again."""
    docs = spark.createDataFrame([(1, "a b c\nd e", "en", "x", 9), (2, "a b c", "en", "x", 5), (3, None, "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.lines(spark, docs, "")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted((r.doc_id, r.text, r.n_chars) for r in done.collect()) == [(1, "a b c\nd e", 9), (3, None, None)]
