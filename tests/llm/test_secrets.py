"""Secret scans on findings that the training set's generator didn't make."""

from __future__ import annotations

import random
import string

from sparkfold.llm import secrets

SCHEMA = "doc_id long, text string"


def held_out(n: int, seed: int) -> list[tuple[str, str, int]]:
    """(text, finding, label): configuration lines, shell commands and code against prose, links, logs and tables."""
    r = random.Random(seed)
    alnum = lambda k: "".join(r.choices(string.ascii_letters + string.digits, k=k))
    full = lambda k: "".join(r.choices(string.ascii_letters + string.digits + "!@#$%^&*", k=k)) + "q"
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    names = ["harbour", "window", "glacier", "marble", "station", "orchard", "lantern", "meadow", "quarter", "village"]
    name = lambda: r.choice(names)
    made = []
    for k in range(n):
        if k % 2:
            form, x = r.choice([
                ("export DB_PASSWORD={}\nrun it", full(r.randint(9, 15))), ("aws key AKIA{} was left in", None), ("curl -H 'Authorization: Bearer {}' host", alnum(40)),
                ('{{"api_key": "{}", "n": 1}}', alnum(32)), ("client_secret: {}", hexes(40)), ('const token = "{}";', "ghp_" + alnum(36)), ('password="{}"', "".join(r.choices(string.ascii_letters, k=20))),
                ("the password is {} for now", full(10)),
            ])
            if x is None:
                x = "AKIA" + "".join(r.choices(string.ascii_uppercase + "234567", k=16))
                form = form.replace("AKIA{}", "{}")
            made.append((form.format(x), x, 1))
        else:
            form, x = r.choice([
                ("we met on {} in the town", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1960, 2024)}"), ("read http://www.{} for more", f"{name()}{name()}.org/{name()}/{name()}.html"),
                ("commit {} fixed it", hexes(40)), ("md5: {}", hexes(32)), ("write to {} soon", f"{name()}.{name()}@{name()}.com"), ("phone {} at noon", f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"),
                ("the {} class was moved", name().title() + name().title() + "Factory"), ("see src/{} there", f"{name()}/{name()}/{name()}_test.py"), ("order {} was sent", "".join(r.choices(string.digits, k=12))),
                ("it grew by {} in a year", f"{r.randint(10, 99)}.{r.randint(100000, 999999)}%"),
            ])
            made.append((form.format(x), x, 0))
    return made


def test_recall_and_precision_on_held_out_findings(spark):
    rows = held_out(800, 5)
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], SCHEMA)
    got = [x for x in secrets.scan(df).collect() if x["secret"]]
    hit = {x["doc_id"] for x in got}
    caught = sum(k in hit for k, r in enumerate(rows) if r[2])
    false = sum(k in hit for k, r in enumerate(rows) if not r[2])
    print("caught", caught, "of 400, false", false)
    assert caught >= 360 and false <= 20
    by = {(x["doc_id"], x["begin"], x["length"]) for x in got}
    exact = sum((k, len(t[: t.index(x)].encode()), len(x)) in by for k, (t, x, y) in enumerate(rows) if y)
    assert exact >= 340


def test_no_gate_hides_letters_marks_or_short_ones(spark):
    texts = ['password = "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy"', 'password = "Ab3$x9!q"', "pwd: hunter2secret", "an ordinary sentence of uncomplicated vocabulary", None, "", "é" * 50, "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {x["doc_id"]: x for x in secrets.scan(df).collect()}
    assert {0, 1, 2} <= got.keys() <= {0, 1, 2} and got[0]["secret"] and got[1]["secret"]
    assert [(got[k]["begin"], got[k]["length"]) for k in (0, 1)] == [(12, 32), (12, 8)]
