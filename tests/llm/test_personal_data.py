import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import personal_data
from tessera.llm.personal_data import Rewritten, Span, find, find_all, find_personal_data, luhn, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-% 0123456789()\nж", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [tuple(s) for s in find(text)] == plain(text)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
        ("x john [at] mail (dot) example {dot} org!", "email", "john [at] mail (dot) example {dot} org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("joh​n@ex​ample.com", "email", "joh​n@ex​ample.com"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("no ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("192 dot 168 dot 1 dot 10", "ip", "192 dot 168 dot 1 dot 10"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = find_all(text)
    added = [(s.kind, text[s.start : s.end]) for s in every if s not in base]
    assert added == [(kind, found)]


@pytest.mark.parametrize("text", ["we met at noon. The dot is red", "look at that", "one two three", "at dot at dot", "[at] (dot)", "zero"])
def test_plain_prose_has_none(text):
    assert find_all(text) == ([], [])


def test_base_spans_stay_among_disguises():
    text = "a@b.cd and e [at] f [dot] gh and +12 345 678 90"
    base, every = find_all(text)
    assert set(base) <= set(every) and len(every) == len(base) + 1


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a@" * 100_000, "[" + " " * 200_000 + " dot x"):
        find_all(text)


def test_documents(documents):
    got = find_personal_data(documents).collect()
    assert len(got) == documents.count()
    spans = sorted([(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got if r["spans"]])
    assert spans == [(3, [("email", 50, 58)]), (5, [("email", 50, 58)])]


def test_redaction_keeps_columns(documents):
    out = redact(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert out.where("text LIKE '%Mail <email> now!'").count() == 2 and out.where("text IS NULL").count() == 1


def test_empty_table(empty):
    assert find_personal_data(empty).count() == 0 and redact(empty).count() == 0


@pytest.mark.parametrize(
    "text,kind,found,left",
    [
        ("x jane.dоe@example.com y", "email", "jane.dоe@example.com", "x <email> y"),
        ("x jane@mail.exаmple.com y", "email", "jane@mail.exаmple.com", "x <email> y"),
        ("x jane@example.cоm y", "email", "jane@example.cоm", "x <email> y"),
        ("x ja​ne@example.com y", "email", "ja​ne@example.com", "x <email> y"),
        ("x jane [at] 10.0.0.1 y", "email", "jane [at] 10.0.0.1", "x <email> y"),
    ],
)
def test_a_fragment_does_not_hide_the_whole(spark, text, kind, found, left):
    base, every = find_all(text)
    assert base and set(base) <= set(every)
    assert [(s.kind, text[s.start : s.end]) for s in every if s not in base] == [(kind, found)]
    assert [r["text"] for r in redact(spark.createDataFrame([(text,)], "text string")).collect()] == [left]


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail jane.doe at example.com now", "email", "jane.doe at example.com"),
        ("mail jane at example.com.", "email", "jane at example.com"),
        ("mail jane at mail.example dot com now", "email", "jane at mail.example dot com"),
        ("mail jane at mail dot example.com now", "email", "jane at mail dot example.com"),
        ("mail jane at mail[.]example (dot) org now", "email", "jane at mail[.]example (dot) org"),
        ("mail jane @ example.com now", "email", "jane @ example.com"),
        ("mail jane@ example.com now", "email", "jane@ example.com"),
        ("mail jane @example dot com now", "email", "jane @example dot com"),
        ("at one nine two dot one six eight dot one dot one it is", "ip", "one nine two dot one six eight dot one dot one"),
        ("at one nine two.one six eight.one.two three it is", "ip", "one nine two.one six eight.one.two three"),
    ],
)
def test_bare_signs_before_a_host_and_spoken_addresses(text, kind, found):
    assert [(s.kind, text[s.start : s.end]) for s in find_all(text)[1]] == [(kind, found)]


@pytest.mark.parametrize(
    "text",
    [
        "it is available at example.com today",
        "write to us at www.example.com or look at example.org/jane",
        "we stayed at home.It rained",
        "apples @ 3.50 each, open at 5.30",
        "one dot two dot three",
        "he arrived at approx. noon",
    ],
)
def test_prose_with_hosts_and_prices_has_none(text):
    assert find_all(text) == ([], [])


def test_many_bare_signs_take_linear_time():
    for text in (" at a.b" * 30_000, " @ " * 60_000, " at " + "a." * 100_000, "one dot " * 30_000, " at " + "a dot " * 30_000):
        find_all(text)


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("ruf plus vier neun eins sieben zwei drei vier fünf sechs an", "phone", "plus vier neun eins sieben zwei drei vier fünf sechs"),
        ("appelle plus trois trois six un deux trois quatre cinq six ici", "phone", "plus trois trois six un deux trois quatre cinq six"),
        ("llama más tres cuatro seis uno dos tres cuatro cinco seis ya", "phone", "más tres cuatro seis uno dos tres cuatro cinco seis"),
        ("écris à jean (arobase) exemple (point) fr ici", "email", "jean (arobase) exemple (point) fr"),
        ("escribe a juan arroba ejemplo punto com ya", "email", "juan arroba ejemplo punto com"),
        ("schreib an jan at beispiel punkt de heute", "email", "jan at beispiel punkt de"),
        ("mail 𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦 now", "email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦"),
        ("mail j̶o̶h̶n̶@̶e̶x̶.̶com now", "email", "j̶o̶h̶n̶@̶e̶x̶.̶com"),
        ("mail john_at_example_dot_com now", "email", "john_at_example_dot_com"),
        ("host ①⑨②.168.1.10 up", "ip", "①⑨②.168.1.10"),
    ],
)
def test_languages_and_forms(text, kind, found):
    base, every = find_all(text)
    assert [(s.kind, text[s.start : s.end]) for s in every if s not in base] == [(kind, found)]


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon dot or not",
        "open_at_file.py and look_at_this",
        "un deux trois, un deux trois",
        "x² + y³ = 10.0.1 ⁴",
        "le point de vue, der Punkt am Ende, el punto final",
        "plus one, plus two",
    ],
)
def test_prose_of_all_languages_has_none(text):
    assert find_all(text) == ([], [])


PIECES = ["ab", "@", " at ", " dot ", "[at]", "(dot)", ".", "com", "one ", "two ", "7 ", "é", "​", "о", "𝐚", "plus ", " ", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_the_way_back_is_that_of_plain_lists(text):
    """Positions kept for each character, as the offsets stand for."""

    class Listed(Rewritten):
        def __init__(self, text):
            super().__init__(text)
            self.at = [(k, k + 1) for k in range(len(text))]

        def replace(self, changes):
            at, done = [], 0
            for a, b, new in changes:
                at += self.at[done:a] + [(self.at[a][0], self.at[b - 1][1])] * len(new)
                done = b
            self.at = at + self.at[done:]
            super().replace(changes)

    was, personal_data.Rewritten = personal_data.Rewritten, Listed
    try:
        out = personal_data.rewrite(text)
    finally:
        personal_data.Rewritten = was
    assert len(out.at) == len(out.text)
    for a in range(len(out.text)):
        for b in range(a + 1, len(out.text) + 1):
            s = out.source(Span("x", a, b))
            assert (s.start, s.end) == (out.at[a][0], out.at[b - 1][1])


def test_many_disguises_take_linear_time_and_little_memory():
    def seconds(n):
        text = "joe [at] ex [dot] com, " * n
        start = time.perf_counter()
        assert len(find_all(text)[1]) == n
        return time.perf_counter() - start

    seconds(200)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
    text = "plain words " * 100_000 + "joe [at] ex [dot] com"
    tracemalloc.start()
    find_all(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * len(text)


DISGUISES = {
    "brackets": lambda u, h, t: f"{u} [at] {h} [dot] {t}",
    "words": lambda u, h, t: f"{u} at {h} dot {t}",
    "bare at": lambda u, h, t: f"{u} at {h}.{t}",
    "spaces": lambda u, h, t: f"{u} @ {h}.{t}",
    "letters": lambda u, h, t: f"{u.replace('a', 'а')}@{h.replace('o', 'ο')}.{t}",
    "invisible": lambda u, h, t: f"{u[:1]}​{u[1:]}@{h}.{t}",
    "wide": lambda u, h, t: f"{u}＠{h}．{t}",
}


def test_planted_disguises_are_found_and_clean_documents_left_alone(spark):
    """Figures of the README: every planted address, and no added span in documents without one."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    added = [t for t in texts if len(find_all(t)[1]) > len(find_all(t)[0])]
    clean = [t for t in texts if not find_all(t)[1]]
    caught = total = 0
    for k, text in enumerate(clean[:700]):
        make = list(DISGUISES.values())[k % len(DISGUISES)]
        planted, at = make("joana", "host", "com"), text.find(" ") + 1
        out = find_all(text[:at] + planted + " " + text[at:])[1]
        total += 1
        caught += any(s.start <= at and at + len(planted) <= s.end for s in out)
    assert total > 300 and caught == total
    assert len(added) <= 0.02 * len(texts)
