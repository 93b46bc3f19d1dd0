import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after".split()
NAMES = {"en": WORDS, "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur plus pouvoir par avec tout faire mettre autre on mais nous comme ou si leur dire devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(NAMES[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text, lang, source) with nulls, empties, a long text, copies,
    near copies, odd characters, and rows that repeat as they are."""
    rng = random.Random(5)
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(1, 120)), lang, f"s{i % 4}"))
    base = prose(rng, "en", 200)
    for i in range(90, 110):  # near copies in steps, and exact ones
        words = base.split()
        words[(i * 7) % 200] = f"changed{i}"
        rows.append((i, " ".join(words) if i % 4 else base.upper(), "en", "s0"))
    rows += [(110, None, "en", "s1"), (111, "", None, None), (112, "   \t\n ", "fr", None), (113, "12 34 !!", None, "s2"), (114, prose(rng, "en", 30_000), None, "s3")]
    rows += [(115, "é ß İ ΣΑΣ \x1c don't x=1 <|endoftext|> 日本 ½", None, "é"), (116, "SAME text", "en", "s1"), (116, "SAME text", "en", "s1"), (None, "same TEXT", "en", "s1"), (118, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, messy, tmp_path_factory):
    """The rows as a stored table, with columns whose names clash with the operators' own."""
    path = f"file://{tmp_path_factory.mktemp('tables')}/documents"
    df = spark.createDataFrame(messy, SCHEMA)
    for c in ("size", "key", "node", "kept", "n", "rank", "shard", "ids", "part"):
        df = df.selectExpr("*", f"'x' AS {c}")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}/empty"
    docs.limit(0).write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


@pytest.fixture(scope="session")
def word_bpe():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")
