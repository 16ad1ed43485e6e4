"""Cases that earlier versions of the text operators left out."""

import random
import string

from meterloom.llm import decontaminate as dc, secret_scan as ss


def test_near_match_is_given_to_the_document_that_has_it():
    window = [f"w{i}" for i in range(13)]
    before = " ".join([f"w{i} pad pad pad pad pad pad pad pad" for i in (4, 3, 2, 1, 0)] * 2)
    row = dc.shard_row([0, 1], [before, " ".join(window[5:])])
    found = dc.search_shard(dc.test_block([("item", " ".join(window))], dc.WINDOW), row[1], *row[2:], dc.SLOP)
    assert [f[2] for f in found] == [[], ["item"]] and [f[0] for f in found] == [[], []]


def test_a_harmless_word_hides_its_own_part_only():
    rng = random.Random(11)
    secret = "Zq8vT3nLw0RbYx5KdPj7HsUe2MfGc9Ai"
    for text in (f"DATA=/srv/samples/key={secret}", f"DATA=/srv/sample/key={secret}", "resample_hook-" + "".join(rng.sample(string.ascii_letters + string.digits, 31)) + "7"):
        added = [s for s in ss.spans_of(text) if s[0] == "entropy_base64"]
        assert added and added[-1][2] == len(text), text
    for text in (f"sample-{secret}", f"sha512-{secret}/{secret}==", "/x=123e4567-e89b-12d3-a456-426614174000/"):
        assert not ss.spans_of(text), text
