import pickle
import random

from marginalia.llm.leak import Automaton, leaked_passages, without_leaks


def brute(text, items, k):
    w, out = text.split(), {}
    for i, t in items:
        v, best = t.split(), 0
        for a in range(len(w)):
            for b in range(len(v)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                best = max(best, n)
        if best >= k:
            out[i] = best
    return out


def test_automaton_equals_all_pairs_of_places():
    rng = random.Random(2)
    for trial in range(400):
        letters = "abc" if trial % 2 else "abcdefgh"
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))) for i in range(5)]
        k = rng.randint(2, 5)
        auto = pickle.loads(Automaton(items, k, 1e9, 0).packed())
        for _ in range(3):
            text = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 30))) + " " + items[rng.randrange(5)][1][3:20]
            best, runs = auto.matches(text.split())
            assert best == brute(text, items, k)
            assert runs == marked(text.split(), [t.split() for _, t in items], k)


def marked(words, items, k):
    """The words that lie in a run of k words or more that some item has, as runs."""
    grams = {tuple(t[i : i + k]) for t in items for i in range(len(t) - k + 1)}
    gone = set()
    for i in range(len(words) - k + 1):
        if tuple(words[i : i + k]) in grams:
            gone |= set(range(i, i + k))
    runs = []
    for i in range(len(words) - k + 1):  # runs that touch are one
        if tuple(words[i : i + k]) in grams:
            if runs and runs[-1][1] >= i:
                runs[-1][1] = i + k
            else:
                runs.append([i, i + k])
    return [tuple(r) for r in runs]


def test_short_items_are_found_whole():
    auto = Automaton([(1, "the harbour court sat today"), (2, "only four words here"), (3, " ".join(map(str, range(20))))], 13)
    assert auto.matches("yesterday the harbour court sat today again".split())[0] == {1: 5}
    assert auto.matches("yesterday the harbour court sat again".split())[0] == {} == auto.matches("only four words here".split())[0]
    assert auto.matches([str(i) for i in range(12)])[0] == {} and auto.matches([str(i) for i in range(3, 16)])[0] == {3: 13}
    half = Automaton([(3, " ".join(map(str, range(20))))], 13, 0.5)
    assert half.matches([str(i) for i in range(5, 15)])[0] == {3: 10} and half.matches([str(i) for i in range(5, 14)])[0] == {}


def test_an_automaton_of_a_megabyte_stays_small():
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 6))) for _ in range(200))) for i in range(1000)]
    packed = Automaton(items).packed()
    assert sum(len(t) for _, t in items) > 950_000 and len(packed) < 32 << 20


ITEM = "Which of these nine excerpts supports the verdict of the harbour court, and which does not?"
DOCS = [
    (1, "Intro. which OF these; nine excerpts\n> supports the verdict of the harbour court AND ... end", "x"), (2, "which of these nine excerpts supports the verdict of the harbour", "x"),
    (3, None, "x"), (4, "", "x"), (None, ITEM, "x"), (5, "word " * 200_000 + ITEM, "x"), (1, "nothing", "x"), (6, "_".join(ITEM.split()), "x"),
]


def test_documents_and_items(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, 1), (7, ITEM, 1), (8, None, 1), (None, ITEM, 1), (9, "short", 1), (11, "verdict of the harbour court", 1), (12, "the harbour court", 1), (10, "then " + ITEM, 1)], "item_id bigint, text string, doc_id int")
    for shard, one_pass in ((8 << 20, 1 << 28), (10, 1 << 28), (10, 1)):  # one automaton; one for each item; a pass for each of them
        got = {(r.doc_id, r.item_id, r.longest) for r in leaked_passages(docs, items, shard_bytes=shard, pass_bytes=one_pass).collect()}
        assert {g for g in got if g[1] != 11} == {(1, 7, 13), (1, 10, 13), (5, 7, 16), (5, 10, 16), (6, 7, 16), (6, 10, 16)}
        assert {g for g in got if g[1] == 11} == {(i, 11, 5) for i in (1, 5, 6)}  # an item of five words, whole
        again = {r.doc_id: (r.text, r.dropped) for r in without_leaks(docs, items, shard_bytes=shard, pass_bytes=one_pass).collect()}
        assert again == (clean := again if shard > 10 else clean)
    assert clean[1] == ("Intro.  ... end", True) and clean[5][0].endswith("word ?") and not clean[5][1] and set(clean) == {1, 5, 6}
    assert leaked_passages(docs.limit(0), items).count() == 0 and leaked_passages(docs, items.limit(0)).count() == 0
