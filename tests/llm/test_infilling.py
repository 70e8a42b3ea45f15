import hashlib
import re

import pytest

from checks.compare import difference, oracle
from flagstone.llm.infilling import infill, unit_starts
from flagstone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(key, text, seed=1, rate=90, spm=20):
    """Units, form, parts' lengths and output of one document, from the definition."""
    text = text or ""
    units = UNIT.findall(text)
    h = sha(f"{seed}:{'' if key is None else key}")
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_equals_its_sql(spark):
    name = "op11_fill_in_middle"
    assert difference(spark, oracle(SF), QUERIES[name], ORACLES[name], SF) is None


def test_units():
    for text in ["", "a", "ab1c", "é\n日b", "--a--", "x" * 50]:
        data = text.encode()
        starts = [*unit_starts(data).tolist(), len(data)]
        assert [data[a:b].decode() for a, b in zip(starts, starts[1:])] == UNIT.findall(text)


@pytest.mark.parametrize("size", [4, 5, 1 << 16])
def test_outputs_and_restored_texts_equal_the_definition(spark, size):
    texts = ["", None, "one two", "ab<P>cd", "x<", "<", "P>", "a<S", "日本é👍 z\n\r\n", "word " * 3000, "k" * 9000, "<<P", "S><"]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts * 6)] + [(3, "again", 1, "y")] * 3 + [(None, "no key at all", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, _row string").repartition(3)
    found = infill(docs, size=size, keep=True).collect()
    wanted = [(i, *brute(i, t), t or "") for i, t, *_ in rows]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found]
    assert sorted(got, key=lambda r: str(r)) == sorted(wanted, key=lambda r: str(r))
    assert all((r.output_sha256, r.restored_sha256) == (sha(r.output), sha(r.restored)) for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_rates(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(200)], "id long, body string")
    assert infill(docs.limit(0), "id", "body").collect() == []
    assert {r.form for r in infill(docs, "id", "body", rate=0).collect()} == {"plain"}
    assert {r.form for r in infill(docs, "id", "body", rate=100, spm=100).collect()} == {"spm"}
    forms = [(r.id, r.form) for r in infill(docs, "id", "body", seed=5).collect()]
    assert sorted(forms) == [(i, brute(i, f"some words {i}", 5)[1]) for i in range(200)]


def test_pieces_are_shuffled_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = infill(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
