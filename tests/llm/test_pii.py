import random
import re
import time

from tessera.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(x):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(x[::-1])) % 10 == 0


def base(x):
    x = x or ""
    return (
        [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(x)]
        + [f"ip:{m.start()}:{m.end()}" for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
        + [f"card:{m.start()}:{m.end()}" for m in CARD.finditer(x) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
        + [f"phone:{m.start()}:{m.end()}" for m in PHONE.finditer(x) if 9 <= len(digits(m.group())) <= 15]
    )


def test_forms_are_the_expressions():
    rng = random.Random(1)
    texts = ["a@b.c@d.e", "@b.c@d.e", "x.@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "000255.1.1.1", "4111 1111-1111 1111", "4111111111111111 4", "+1 (988) 555-2485.", "+1", "+12 ( ) -", "a@b", "é@é.com a@b.co"]
    texts += ["".join(rng.choice("01249.@+- ()ab\né") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for t in texts:
        found, _ = pii.scan(t)
        assert [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k]] == base(t), t


def test_long_runs_take_no_quadratic_time():
    start = time.process_time()
    pii.scan("a" * 1_000_000 + "1")
    pii.scan("日" * 500_000 + "9@" + "語" * 500_000)
    pii.scan("x1 " * 100_000 + "1.2.3.4 " * 20_000)
    assert time.process_time() - start < 20
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.scan(t)


def test_patterns_find_unseen_values(spark):
    rows = [(k, f"Please call me at +1 (98{k}) 555-24{k}5 today.") for k in range(8)]
    rows += [(20, "Please call me at 988-555-2499 today."), (21, "Version 2.0 of call 5551234567."), (22, None), (23, ""), (None, "mail x@y.org"), (0, rows[0][1])]
    found = {(r.doc_id, r.n_phone): r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = found[20, 0]
    assert new.base == [] and new.spans == [f"phone:{rows[8][1].index('988')}:{rows[8][1].index(' today')}"]
    assert found[21, 0].spans == [] and found[22, 0].spans == [] and found[None, 0].base == ["email:5:12"]
    assert all(found[k, 1].spans == found[k, 1].base == base(rows[k][1]) for k in range(8))


def test_precision_and_recall_on_planted_values(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def card():
        x = number(15)
        return next(x + c for c in "0123456789" if luhn(x + c))

    seeds = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card, "phone": lambda: f"+{number(11)}"}
    near = {"email": lambda: f"{word()}@{word()}", "ip": lambda: f"{rng.randint(300, 900)}.{number(1)}.{number(2)}.{rng.randint(256, 999)}", "card": lambda: number(14) + "0", "phone": lambda: f"{number(3)}-{number(4)}"}
    near["card"] = lambda: next(x for x in iter(lambda: number(16), None) if not luhn(x))
    around = {"email": ["write to {} for more", "mail: {}"], "ip": ["the server at {} is down", "host= {}"], "card": ["card number {} was charged", "paid with {} on"], "phone": ["please call {} before noon", "tel: {}"]}
    rows, want = [], set()
    for kind in seeds:
        for k in range(60):
            planted = k % 3 == 0
            value = (near if planted else seeds)[kind]()
            left = " ".join(word() for _ in range(rng.randint(0, 6)))
            text = f"{left} {rng.choice(around[kind]).format(value)} {word()}".strip()
            if planted:
                want.add((len(rows), f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"))
            rows.append((len(rows), text))
        rows += [(len(rows) + k, f"{word()} {word()} {near[kind]()} {word()}") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    added = {(r.doc_id, x) for r in pii.extract(frame).collect() for x in set(r.spans) - set(r.base)}
    assert len(added & want) >= 0.9 * len(want) and len(added & want) >= 0.95 * len(added), (len(added & want), len(want), len(added))


def test_no_pattern_from_few_seeds(spark):
    rows = [(k, f"ring +1 (98{k}) 555-24{k}5 now") for k in range(2)] + [(9, "ring 988-555-2499 now")]
    assert all(r.spans == r.base for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_empty(spark):
    none = pii.digest(pii.extract(spark.createDataFrame([], "doc_id long, text string, base string")))
    assert none.count() == 0 and none.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]


def test_values_beside_long_words_have_patterns(spark):
    rng = random.Random(3)
    run = lambda: "".join(rng.choice("ABCDEFxyz0123") for _ in range(90))
    same, other = "q" * 30 + "-7x" * 20, "z" * 50
    rows = [(k, f"{run()} reach +1 (98{k}) 555-24{k}5 now") for k in range(8)] + [(20, f"{run()} reach 988-555-2499 now")]
    rows += [(30 + k, f"{same.replace('7', str(k))},{k}@x.org;{other} tail") for k in range(8)] + [(50, f"{same} me@host {other}"), (51, f"{same}y me@host {other}"), (52, f"{same} me@host {other}y")]
    found = {r.doc_id: set(r.spans) - set(r.base) for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = lambda k, value, kind: f"{kind}:{dict(rows)[k].index(value)}:{dict(rows)[k].index(value) + len(value)}"
    assert {k: v for k, v in found.items() if v} == {20: {at(20, "988-555-2499", "phone")}, 50: {at(50, "me@host", "email")}}


def test_keys_of_long_words_are_those_of_their_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aB9,:1ΣςİÉ.0") for _ in range(rng.randint(1, 130)))
        cuts = sorted(rng.sample(range(1, len(text) + 1), min(len(text), 5)))
        assert list(pii._keys(text, cuts)) == [next(pii._keys(text[:c], [c])) for c in cuts]


def test_many_values_in_a_long_run_take_no_quadratic_time():
    start = time.process_time()
    text = ",".join(f"u{k}@b.co" for k in range(60_000))
    base, values = pii.scan(f"{'w' * 200_000} {text} {'v' * 200_000}")
    assert len(base["email"]) == 60_000 and len({v["start"] for v in values}) == 60_000
    assert time.process_time() - start < 30
