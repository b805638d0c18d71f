import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vektorium.llm import leaks, mixing, pii, pii_model, pii_train

WORDS = [f"w{i}" for i in range(400)] + ["42", "ms", "the", "of"]


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", text or "")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def leaked(doc, passage):
    d, p = words(doc), words(passage)
    runs = {tuple(d[i : i + 12]) for i in range(len(d) - 11)}
    if any(tuple(p[i : i + 12]) in runs for i in range(len(p) - 11)):
        return True
    return any(lcs(p[i : i + 30], d[j : j + 40]) >= 25.5 for i in range(len(p) - 29) for j in range(max(1, len(d) - 39)))


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, "Do this.\n" + text(45), text(34) if i % 3 else None) for i in range(6)]
    docs = []
    for n in range(90):
        src = r.choice(items)
        p = words(r.choice([src[1].split("\n")[1], src[2] or src[1].split("\n")[1]]))
        kind, body = n % 6, list(p)
        if kind == 0:
            body = p[5 : 5 + r.choice([11, 12])]
        elif kind == 1:
            for _ in range(r.randint(3, 7)):
                body[r.randrange(len(body))] = "zz"
        elif kind == 2:
            for _ in range(r.randint(6, 18)):
                body.insert(r.randrange(len(body)), "zz")
        elif kind == 3:
            body = [w for w in p if r.random() > r.choice([0.1, 0.2])]
        elif kind == 4:
            body = [w + r.choice(["", "\n//", ",", "  "]) for w in body]
        else:
            body = text(30).split()
        t = text(r.randint(0, 8)) + " é-" + r.choice([" ", "\r\n"]).join(body) + "— " + text(r.randint(0, 8))
        docs.append((n, t.title() if n % 4 == 0 else t))
    docs += [(900, None), (901, ""), (902, "short"), (None, docs[0][1])]
    want = {(i, d) for i, pr, so in items for d, t in docs if d is not None and any(leaked(t, x) for x in [pr.split("\n")[1], so or ""])}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame([*items, (77, None, None), (78, "one line only, nothing behind it", None), (None, "a\n" + "b " * 40, None)], "item_id long, prompt string, solution string")
    got = {tuple(x) for x in leaks.leaks(df, it).collect()}
    assert got == want and 20 < len(want)
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def test_windows_never_cross_documents(spark):
    p = " ".join(f"u{i}" for i in range(40))
    it = spark.createDataFrame([(1, "x\n" + p, None)], "item_id long, prompt string, solution string")
    halves = spark.createDataFrame([(1, " ".join(p.split()[:8])), (2, " ".join(p.split()[8:16]))], "doc_id long, text string").coalesce(1)
    assert leaks.leaks(halves, it).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHUNK", 1000)
    p = " ".join(f"u{i}" for i in range(40))
    items = leaks.build_items([(1, "x\n" + p, None)])
    b = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array(["pad " * 3000 + p + " pad" * 3000, "x" * 5000])], names=["doc_id", "text"])
    assert [r for o in leaks.find_leaks(iter([b]), items) for r in o.to_pylist()] == [{"item_id": 1, "doc_id": 5}]


FORM = "given a row of {a} marks walk it from the {b} end and drop {a} whenever {b} was seen then count how many {a} stay under {n} and raise a fault on anything else in {b} order up to {n} or {m}"


@pytest.mark.parametrize("others", [0, 2, 4])
def test_reparameterised_whatever_else_is_asked(spark, others, monkeypatch):
    rows = [(i, "Do.\n" + FORM.format(a=f"alpha{i}x", b=f"beta{i}y", n=10 + i, m=7), None) for i in range(1 + others)]
    it = spark.createDataFrame(rows, "item_id long, prompt string, solution string")
    texts = [FORM.format(a="gamma", b="delta", n=99, m=99), FORM.replace("{a}", "{c}", 1).format(a="eta", b="theta", c="theta", n=9, m=8), FORM.replace("{n}", "5", 1).format(a="iota", b="kappa", n=9, m=8), "nothing", "", None]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {(r.item_id, r.doc_id, r.n_changed > 0) for r in leaks.reparameterised(docs, it).collect()}
    assert got == {(i, 1, True) for i in range(1 + others)}  # names and numbers must be filled consistently
    monkeypatch.setattr(leaks, "MAX_ITEM_WORDS", 50)  # a block for each item
    assert {(r.item_id, r.doc_id, r.n_changed > 0) for r in leaks.reparameterised(docs, it).collect()} == got
    assert leaks.reparameterised(docs.limit(0), it).count() == 0


def test_fillers_of_other_lengths(spark):
    it = spark.createDataFrame([(1, "Do.\n" + FORM.format(a="alpha_one", b="beta_two", n=10, m=7), None)], "item_id long, prompt string, solution string")
    docs = spark.createDataFrame([(1, FORM.format(a="gamma", b="delta", n="3.5", m=8))], "doc_id long, text string")
    assert [(r.item_id, r.doc_id) for r in leaks.reparameterised(docs, it).collect()] == [(1, 1)]


def test_long_repetitive_text(spark, monkeypatch):
    p = " ".join(f"u{i % 9}" for i in range(60))
    it = spark.createDataFrame([(1, "x\n" + p, None)], "item_id long, prompt string, solution string")
    docs = spark.createDataFrame([(1, " ".join(f"u{i % 9}" for i in range(9000))), (2, "u1 u2 " * 5000)], "doc_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, it).collect()] == [(1, 1)]
    monkeypatch.setattr(leaks, "REGION", 100)
    assert [tuple(r) for r in leaks.leaks(docs, it).collect()] == [(1, 1)]


def test_token_counts_equal_the_tokenizer():
    path, pattern = mixing.default_tokenizer()
    c = mixing.TokenCounter(path, pattern)
    r = random.Random(1)
    alphabet = ["a", "B", "don't", "we'll", " ", "  ", "\n", "\t", "1", "23", "(", "='", "'s", "é", "日本", " ", " ", "\x1c", "�", "😀", "_", "x'", "<|endoftext|>"]
    texts = ["", "x", " ", "\n\n  a"] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(400)]
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    assert c.count(np.frombuffer(b"".join(data), np.uint8), off).tolist() == [len(c.encode(t)) for t in texts]


def test_plan_meets_targets_or_limits():
    have = {"a": 1000, "b": 100, "c": 0}
    goal = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2), "d": (0.0, 1)}
    p = mixing.plan(have, goal)
    assert p["a"].budget + p["b"].budget == pytest.approx(400 / 0.375) and p["a"].budget / p["b"].budget == pytest.approx(5 / 3)
    assert p["c"].budget == 0 and p["b"].blocks == 4
    more = mixing.plan(have, goal, total=1300)
    assert all(b.budget <= b.available * b.max_repeats + 1e-6 for b in more.values()) and sum(b.budget for b in more.values()) == pytest.approx(1300)
    assert more["b"].budget == pytest.approx(400, rel=1e-3)
    assert mixing.plan({}, goal)["a"].budget == 0


def test_exponent_is_bisected():
    have, goal = {"a": 1000, "b": 100}, {"a": (0.2, 4), "b": (0.8, 4)}
    p = mixing.plan(have, goal, total=1100)
    assert 0 < p["a"].exponent < 1 and p["b"].budget == pytest.approx(400, rel=1e-6) and p["a"].budget == pytest.approx(700, rel=1e-6)
    assert mixing.plan(have, goal, total=300)["a"].exponent == 1
    w, t = mixing.entropy_weights({"a": 900, "b": 100}, 0.9)
    assert mixing.bits(w) == pytest.approx(0.9, abs=1e-6) and 0 < t < 1
    e = mixing.plan_by_entropy(have, goal, 0.9)
    assert mixing.bits({s: b.budget for s, b in e.items()}) == pytest.approx(0.9, abs=1e-6) and e["a"].exponent == pytest.approx(e["b"].exponent)
    limited = mixing.plan_by_entropy(have, {"a": (0.5, 1), "b": (0.5, 2)}, 1.0)  # equal weights would need 5.5 passes over b
    assert limited["b"].budget == pytest.approx(200, rel=1e-6) and e["a"].exponent < limited["a"].exponent < 1
    assert mixing.plan_by_entropy({}, goal, 1.0)["a"].budget == 0 and mixing.entropy_weights({"a": 5}, 3.0)[0] == {"a": 1.0}


def test_targets_are_read_like_sources(spark, monkeypatch):
    t = spark.createDataFrame([("Forge-Main", 0.5, 2), ("forge_main", 0.2, 4), (None, 0.1, 1), ("x", None, None)], "source string, target_weight double, max_repeats int")
    assert mixing.wanted_of(t) == {"forge_main": (pytest.approx(0.7), 4), "x": (0.0, 0)}
    assert mixing.wanted_of(t.limit(0)) == {} and mixing.available_tokens(spark.createDataFrame([("a", 1)], "source string, n_tokens long"), {}) == {}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.wanted_of(t)


def test_draw(spark):
    r = random.Random(2)
    rows = [("a", i, r.randint(1, 50)) for i in range(800)] + [("b", 1000 + i, r.randint(1, 50)) for i in range(40)] + [("a", 5000, 0), ("a", None, 9), (None, 1, 5)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long").repartition(3)
    have = {s: sum(n for x, d, n in rows if x == s and d is not None) for s in "ab"}
    p = mixing.plan(have, {"a": (0.7, 1), "b": (0.3, 5)})
    got = mixing.draw(df, p).collect()
    used = {s: sum(x.n_tokens for x in got if x.source == s) for s in "ab"}
    for s in "ab":
        assert abs(used[s] - p[s].budget) <= 26
        assert max(x.block for x in got if x.source == s) <= p[s].max_repeats
    assert len({(x.doc_id, x.block) for x in got}) == len(got) and all(0 <= x.mix_key <= 1 for x in got)
    assert sorted((tuple(x) for x in mixing.draw(df, p).collect())) == sorted(tuple(x) for x in got)
    assert mixing.draw(df.limit(0), p).count() == 0


def test_source_spellings(spark):
    df = spark.createDataFrame([(" Forge-Main ",), ("FORGE_MAIN",), (None,)], "s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(mixing.source_name(F.col("s"))).collect()] == ["forge_main", "forge_main", None]


def test_tagger_on_held_out_lines():
    t = pii_model.Tagger.load(pii.MODEL)
    maker = pii_train.Maker(987654, pii_train.program_lines(1))
    lines = [maker.line() for _ in range(3000)]
    got = [{(a, b, k) for _, a, b, k in pii.spans_in(t, [x[0]])} for x in lines]
    want = [set(x[1]) for x in lines]
    hit = sum(len(g & w) for g, w in zip(got, want))
    assert hit / sum(map(len, want)) > 0.9 and hit / sum(map(len, got)) > 0.9


def test_tagger_on_lines_written_by_hand():
    """Forms that are neither in the training templates nor in the tables."""
    t = pii_model.Tagger.load(pii.MODEL)
    hit = found = real = 0
    for line in HAND.strip().split("\n"):
        parts, text, want = re.split(r"\[\[(\w):(.*?)\]\]", line), "", set()
        for i in range(0, len(parts), 3):
            text += parts[i]
            if i + 2 < len(parts):
                want.add((pii_train.KINDS[parts[i + 1]], parts[i + 2]))
                text += parts[i + 2]
        got = {(k, text[a:b]) for _, a, b, k in pii.spans_in(t, [text])}
        hit, found, real = hit + len(got & want), found + len(got), real + len(want)
    assert hit / real > 0.8 and hit / found > 0.8, (hit, found, real)


def test_training_lowers_the_loss():
    losses = []
    pii_train.train(lines=1200, epochs=3, scan_epochs=1, say=lambda s: losses.append(float(m[1])) if (m := re.search(r"outputs 11.*loss ([\d.]+)", s)) else None)
    assert losses[-1] < losses[0] * 0.8


def test_find_and_redact(spark):
    text = 'x = 1\n// Contact Mirabel van Oosterhoek, tel. +44 7700 900123 before noon\r\nlog("mail: j.smith@example.org")\n' + "y += 2; " * 300 + '/* lives at: 12 Old Mill Lane, Fernham, QX 12345 */' + " z();" * 300
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "the ticket 925-14-3136 is stuck\n@someone pinged x_1"), (None, text)], "doc_id long, text string").selectExpr("*", "'clash' AS pii_type")
    got = {(r.pii_type, r.pii_value) for r in pii.find(df).where("doc_id = 1").collect()}
    assert got == {("name", "Mirabel van Oosterhoek"), ("phone", "+44 7700 900123"), ("email", "j.smith@example.org"), ("address", "12 Old Mill Lane, Fernham, QX 12345")}
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    want = text
    for kind, value in got:
        want = want.replace(value, f"[{kind.upper()}]")
    assert out[1].text == want and out[1].n_replaced == 4
    assert out[2].text is None and out[3].text == "" and "925-14-3136" in out[4].text
    assert pii.find(df.limit(0)).count() == 0


def test_windows_are_reconciled():
    t = pii_model.Tagger.load(pii.MODEL)
    for pad in range(150, 330, 12):
        line = "value " * (pad // 6) + "mail to jane.doe@mail.example.org or call +1-202-555-0143 now " + "value " * 60
        found = {line[a:b] for _, a, b, _ in pii.spans_in(t, [line])}
        assert {"jane.doe@mail.example.org", "+1-202-555-0143"} <= found, pad


def test_every_character_is_in_a_window():
    text = "  ab\n\r\n\t" + "x" * 700 + "\n" + " " * 5 + "\nend" + "y" * 321
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first, last, line = pii.windows_of(code)
    seen = np.zeros(len(text), bool)
    for a, b in zip(first, last):
        seen[a:b] = True
        assert b - a <= pii.WINDOW and not set(text[a:b]) & set("\r\n")
    assert {text[i] for i in np.flatnonzero(~seen)} <= set(" \t\r\n") and (np.diff(line) >= 0).all()
    assert [len(x) for x in pii.windows_of(code[:0])] == [0, 0, 0]


#: Values are marked [[kind:value]]; e mail, p phone, i id number, a address, n name.
HAND = """
Dr. [[n:Henrik Lindqvist]] will be out until Thursday
ask [[n:Kim Park]] whether the cron job still runs
she said "[[n:Akira Tanaka]] fixed it last night"
[[a:221 Baker Street, London NW1 6XE]] was the old office
the courier went to [[a:1600 Amphitheatre Pkwy, Springfield, IL 62704]] by mistake
text [[p:+1 (212) 555-0142]] when you land
our landline [[p:020 7946 0958]] rings in the hall
reach support at [[e:help.desk AT contoso DOT com]]
applicant [[i:078-05-1120]] has two open claims
her passport, [[i:L01234567]], expires in May
minutes taken by [[n:Sofia Rossi]] and [[n:Omar Haddad]]
reply to [[e:first.last@sub.domain.co.uk]] only
# credits: [[n:Ingrid Solberg]] (icons), [[n:Tomás Rivera]] (sound)
invoice goes to [[n:Chen Wei]], [[a:45 Orchard Road, Leeds LS1 4AB]]
const owner = "[[n:Priya Raman]]";
notify("[[e:ops-team@acme.io]]")
dial [[p:555-867-5309]] and ask for the night shift
the driver, [[n:Lucia Fernández]], left her card: [[p:+34 612 345 678]]
wohnhaft in [[a:Lindenstraße 12, 10969 Berlin]]
habite au [[a:14 rue de Rivoli, 75004 Paris]]
NINO on file: [[i:AB 12 34 56 C]]
drop off at [[a:9 Harbour View, Cork T12 AB34]]
git blame says [[n:Mateusz Wójcik]] touched this last
{"who": "[[n:Amara Okonkwo]]", "reach": "[[e:amara.o@mail.example.ng]]"}
the fix in ticket 415-555-2671 was reverted
Content Type must be set before Transfer Encoding
upstream is git@code.example:tools/build.git
see Section Four of the Style Guide
part 123-45-6789 rev B ships on Monday
class UserAccountManager extends BaseManager {
postgres://svc:Hunter22pass@db.internal:5432/app
New York and San Francisco are cached separately
the Fourier transform of a Gaussian is a Gaussian
Hello World from Visual Studio
ping @maria on the channel
build 2024.11.03.1187 passed in 12.5 s
Main Street Bank opened a second data center
timeout=30000 retries=5 backoff=1.5
"""
