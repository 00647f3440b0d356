import numpy as np
import pytest

from siltstone.llm import stuffing

PROSE = "When the reader is late, the writer keeps the lock and waits for it. Nobody expected the cache to skip these rows, but it did so in the test. "
SPAM = ["cheap red cabinet, buy red cabinet, best oak rack, order oak rack cheap, free red cabinet, top oak rack online, ", "Home » deals » red cabinet\nStart » red cabinet » oak rack\nHome » oak rack » sale\n", "https://a.example/x/\nwww.b.test/y/\nhttp://c.invalid/?id=4\n", "#red_cabinet #oakrack #buyredcabinet #sale\n", "red cabinet in Rome red cabinet in Oslo red cabinet in Bonn red cabinet in Kiel red cabinet in Graz "]
HONEST = [PROSE, "\n".join(f"2025-01-0{i}T04:18:25Z INFO store: page b1f8a{i} replays cache in {i}44 ms" for i in range(1, 9)), "\n".join(f"    let a{i} = store.map((x) => x.get({i}));" for i in range(9)), "\n".join(f"name_{i}    {i}938 ms 0.{i}74 p95" for i in range(9)), "\n".join(f"- https://a.example/{i}: {PROSE}" for i in range(4)), "The trigger of Rome loads each trigger, and the trigger drops the store.\n" * 6, "\n".join(f'pkg_{i} = "1.{i}.0"' for i in range(9))]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert stuffing.stuffed_share(text * 4) > 0.9
    assert stuffing.stuffed_share(PROSE + "\n\n" + text * 8) > 0.5


@pytest.mark.parametrize("text", HONEST)
def test_honest(text):
    assert stuffing.stuffed_share(text) < 0.3


def test_recurrence():
    ids = np.array([0, 1, 2] * 30 + list(range(10, 60)))
    near, best = stuffing.recurrence(ids)
    assert near[:90].all() and not near[90:].any() and best[10] > 0.9 and best[-1] < 0.3
    assert stuffing.recurrence(np.zeros(0, int))[0].size == 0 and stuffing.recurrence(np.zeros(1, int))[1].tolist() == [0]


def test_segments_cover_everything():
    for text in ("", "a\n\nb", "x" * 2000, "Word one. Another two. " * 60, " \n \n"):
        spans = stuffing.segments(text)
        assert all(b - a <= stuffing.WIDE for a, b in spans)
        assert sum(len(text[a:b].replace(" ", "").replace("\n", "")) for a, b in spans) == len(text.replace(" ", "").replace("\n", ""))


def test_table(spark):
    rows = [(1, SPAM[0] * 5, "x"), (2, PROSE, "x"), (3, None, "x"), (4, "", "x"), (1, SPAM[0] * 5, "x"), (5, "x" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    assert [r[0] for r in stuffing.found(df).collect()] == [1, 1]
    assert stuffing.found(df.limit(0)).count() == 0


NOUNS = "sandals boots loafers sneakers clogs mules pumps slippers brogues moccasins espadrilles wedges heels flats trainers cleats galoshes wellingtons oxfords derbies monks plimsolls stilettos kitten platforms gladiators huaraches jellies slides thongs skates spikes waders chukkas jodhpurs ugg desert chelsea cowboy hiking ankle knee riding rain snow work combat dress court golf tennis bowling dance ballet".split()


@pytest.mark.parametrize("between", [", ", " | ", "; ", " · ", ","])
def test_distinct_keywords(between):
    assert stuffing.stuffed_share(between.join(NOUNS)) > 0.9
    assert stuffing.stuffed_share("\n".join(between.join(NOUNS[i : i + 6]) for i in range(0, len(NOUNS), 6))) > 0.8
    assert stuffing.stuffed_share("Great shoes\n" + PROSE + "\n" + between.join(NOUNS)) > 0.5


def test_honest_lists_of_distinct_words():
    assert stuffing.stuffed_share(", ".join(NOUNS[:12])) == 0
    assert stuffing.stuffed_share(("Kinds: " + ", ".join(NOUNS[:9]) + "\n") + PROSE + "\n" + ", ".join(NOUNS[9:18])) == 0
    assert stuffing.stuffed_share("\n".join("| " + " | ".join(NOUNS[i : i + 4]) + " |" for i in range(0, 40, 4))) == 0
    assert stuffing.stuffed_share("\n".join(f"{a}: {b}, {c}: {d}, {e}" for a, b, c, d, e in zip(*[iter(NOUNS)] * 5))) == 0
    assert stuffing.stuffed_share("\n".join(f"{a}({b}, {c}); {d}, {e}" for a, b, c, d, e in zip(*[iter(NOUNS)] * 5))) == 0


def test_phrases_beside_much_prose():
    phrase = "buy the red cabinet rack in Rome " * 8
    prose = "When it is late, we do not keep the lock and it has to be there for all of us. "
    text = "\n".join([phrase] * 3 + [prose * 3] * 2)
    words = stuffing._WORD.findall(text.lower())
    assert sum(map(stuffing.FUNCTION.__contains__, words)) > 0.36 * len(words)
    assert stuffing.stuffed_share(text) > 0.5
