"""Bootstrapped extraction on a table of planted identifiers: recall and precision of what it adds."""

import random

import pytest

from meterloom.llm import pii


def digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def planted(n, seed=11):
    """Texts, and for each the span (start, end) of an identifier that no base format has, or None.

    A quarter of the identifiers stand in the same contexts as base ones but in other forms; other
    numbers stand in contexts of their own or in none.
    """
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    seen = {
        "phone": lambda: f"+1 (555) {digits(rng, 3)}-{digits(rng, 4)}",
        "email": lambda: f"{rng.choice(words)}.{digits(rng, 2)}@{rng.choice(words)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
    }
    unseen = {
        "phone": lambda: rng.choice([f"555-{digits(rng, 3)}-{digits(rng, 4)}", f"0{digits(rng, 9)}"]),
        "email": lambda: f"{rng.choice(words)}.{digits(rng, 2)}@intranet",
        "ip": lambda: f"fe80::{digits(rng, 4)}:{digits(rng, 4)}:1",
    }
    around = {
        "phone": ["call {} about", "tel:{} {}", "phone = {}", "Phone: {}."],
        "email": ["write to {} or", "mail: <{}>", "contact {}, then"],
        "ip": ["host {} answered", "from {} to", "ip={}"],
    }
    texts, spans = [], []
    for _ in range(n):
        kind = rng.choice(["phone", "email", "ip", "order", "none", "text"])
        if kind == "text":
            texts.append(some(rng.randrange(3, 30)))
            spans.append(None)
            continue
        if kind == "order":
            head, what, tail, mark = some(4) + " ", f"order {digits(rng, 8)}", " shipped " + some(3), None
        elif kind == "none":
            head, what, tail, mark = some(5) + " ", digits(rng, rng.choice([7, 10, 16])), " " + some(4), None
        else:
            new = rng.random() < 0.25
            value = (unseen if new else seen)[kind]()
            form = rng.choice(around[kind])
            before = form[: form.index("{}")]
            head, what, tail = some(rng.randrange(1, 6)) + " " + before, value, form[form.index("{}") + 2 :].replace("{}", some(1)) + " " + some(2)
            mark = kind if new else None
        texts.append(head + what + tail)
        spans.append((f"context_{mark}", len(head), len(head) + len(what)) if mark else None)
    return texts, spans


@pytest.fixture(scope="module")
def found(frame):
    texts, spans = planted(100_000)
    rows = pii.personal_spans(frame(texts, parts=8)).collect()
    return spans, {r.doc_id: [tuple(s) for s in r.spans if s.kind not in pii.BASE] for r in rows}


def test_unseen_identifiers_are_found(found):
    spans, got = found
    wanted = {(i, s) for i, s in enumerate(spans) if s}
    added = {(i, s) for i, own in got.items() for s in own}
    recall, precision = len(wanted & added) / len(wanted), len(wanted & added) / len(added)
    assert len(wanted) > 10_000
    assert recall >= 0.9 and precision >= 0.95, (recall, precision)


def test_contexts_by_chance_add_nothing(frame):
    """Identifiers among words at random: no context says anything, so nothing is added."""
    rng = random.Random(5)
    words = [f"w{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}{'qrstuvwx'[i // 64 % 8]}" for i in range(512)]
    texts = []
    for _ in range(20_000):
        what = rng.choice([f"{rng.choice(words)}@mail.example.com", digits(rng, 16), f"10.0.{rng.randrange(256)}.{rng.randrange(256)}", f"+1 (555) {digits(rng, 7)}"])
        texts.append(f"{rng.choice(words)} {rng.choice(words)} {what} {rng.choice(words)}")
    added = [s for r in pii.personal_spans(frame(texts)).collect() for s in r.spans if s.kind not in pii.BASE]
    assert len(added) <= 20
