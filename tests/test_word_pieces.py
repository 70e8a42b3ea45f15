import random

import pytest

from flagstone.operators.word_pieces import word_pieces


def cut(word, vocab, longest=100):
    """Greedy longest match, from the definition."""
    pieces, at = [], 0
    while at < len(word) <= longest:
        ends = [e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in vocab]
        if not ends:
            return ["[UNK]"]
        pieces.append(("##" if at else "") + word[at:max(ends)])
        at = max(ends)
    return pieces if pieces else ["[UNK]"]


def test_pieces_equal_the_definition(spark):
    rng = random.Random(7)
    letters = "abc"
    tokens = {"[UNK]", "[MASK]", "##", "#", "é", "##日"} | {rng.choice(["", "##"]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    vocab = {t: i for i, t in enumerate(sorted(tokens))}
    texts = [" ".join("".join(rng.choice(letters + "x" * (rng.random() < 0.2)) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    texts += [None, "", "  \t\n ", "[MASK] ab", "é日", "##ab ## #", "a" * 100, "a" * 101, "ab " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id long, text string, token string").repartition(3)
    table = spark.createDataFrame(list(vocab.items()), "token string, id int")
    found = {r.row_id: r for r in word_pieces(df, "text", table).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert found[i].pieces is None and found[i].ids is None
            continue
        wanted = [p for w in text.split() for p in cut(w, vocab)]
        assert found[i].pieces == wanted and found[i].ids == [vocab[p] for p in wanted], text
    assert word_pieces(df.limit(0), "text", table).collect() == []
    with pytest.raises(ValueError):
        word_pieces(df, "text", table.filter("token <> '[UNK]'"))
