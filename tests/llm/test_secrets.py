from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import secrets
from tests.llm.conftest import edge_rows

WORD = string.ascii_letters + string.digits
NAMES = "assign access hex hex_entropy alnum_entropy base64_entropy".split()


def plain_base(text):
    """The fixed shapes, character by character."""
    found = []
    at = 0
    while at < len(text):
        end = assign_end(text, at)
        if end:
            if end[1] >= 8:
                found.append((at, end[0], "assign"))
            at = end[0]
        else:
            at += 1
    for name, head, allowed, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 16),
                                       ("hex", "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in allowed:
                    end += 1
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, end, name))
                at = end
            else:
                at += 1
    return found


def assign_end(text, at):
    """End of an assignment that starts here, and the length of its value; tries what the pattern tries."""
    low = text[at:at + 8].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if not low.startswith(key):
            continue
        i = at + len(key)
        for quoted in ([1, 0] if text[i:i + 1] in ("'", '"') else [0]):
            j = i + quoted
            while text[j:j + 1] == " ":
                j += 1
            if text[j:j + 1] not in (":", "="):
                continue
            j += 1
            while text[j:j + 1] == " ":
                j += 1
            for opening in ([1, 0] if text[j:j + 1] in ("'", '"') else [0]):
                start = end = j + opening
                while end < len(text) and text[end] in WORD + "+/_.=-":
                    end += 1
                if end > start:
                    return end, end - start
    return None


def plain_added(text, classes=secrets.CLASSES, allow=secrets.ALLOW):
    """Windows one by one, each counted anew."""
    for a in ["|".join(f"(?:{a})" for a in allow)] if allow else []:
        text = re.sub(a, lambda m: "\0" * len(m.group()), text)
    out = []
    for c in classes:
        places = set()
        for m in re.finditer(f"[{c.characters}]+", text):
            for at in range(m.start(), m.end() - c.window + 1):
                part = text[at:at + c.window]
                total = sum(round(n * math.log2(n) * (1 << 20)) for n in Counter(part).values())
                groups = sum(any(low <= x <= high for x in part) for low, high in ("az", "AZ", "09"))
                steps = sum(abs(ord(text[i]) - ord(text[i - 1])) <= 1 for i in range(at, at + c.window) if i > m.start())
                bits = math.log2(c.window) - total / (1 << 20) / c.window
                if bits >= c.bits and groups >= c.groups and 2 * steps < c.window:
                    places |= set(range(at, at + c.window))
        new = []
        for i in sorted(places):
            if new and new[-1][1] == i:
                new[-1] = (new[-1][0], i + 1, c.name)
            else:
                new.append((i, i + 1, c.name))
        out += [s for s in new if not any(a <= s[0] and s[1] <= b for a, b, _ in out)]
    return out


def plain(text):
    base = plain_base(text or "")
    added = [s for s in plain_added(text or "") if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    key = lambda s: (s[0], NAMES.index(s[2]))
    return sorted(base, key=key), sorted(base + added, key=key)


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def made_up(rng):
    """Texts with secrets, near misses and harmless look-alikes."""
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    pieces = [
        lambda: f"{rng.choice(['password', 'Passwd', 'SECRET', 'toKen', 'api_key', 'APIKEY'])}{rng.choice(['', chr(34), chr(39)])}"
                f"{rng.choice(['', '  '])}{rng.choice(':=')}{rng.choice(['', ' '])}{rng.choice(['', chr(34)])}{draw(WORD + '+/_.=-', rng.randint(5, 12))}",
        lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, rng.randint(9, 18)),
        lambda: draw("0123456789abcdef", rng.randint(28, 45)), lambda: draw("0123456789ABCDEF", rng.randint(20, 40)),
        lambda: draw(WORD, rng.randint(18, 60)), lambda: draw(WORD + "+/_-", rng.randint(20, 80)),
        lambda: "tokeſ = abcdefghij", lambda: "toKen =abcdefghij", lambda: WORD, lambda: "9" * 40,
        lambda: "https://example.org/" + draw(WORD, 40) + "?k=" + draw(WORD, 30),
        lambda: f"{draw('0123456789abcdef', 8)}-1234-5678-9abc-{draw('0123456789abcdef', 12)}",
        lambda: "sha256:" + draw("0123456789ABCDEF", 64), lambda: "naïve 東京 \U0001f600", lambda: "word and word",
        lambda: "usr/local/share/Documents/2024-report/Final_Version-v12", lambda: "password token secret=: apikey==x"]
    return rng.choice([" ", "", "\n"]).join(rng.choice(pieces)() for _ in range(rng.randint(1, 12)))


def rows_of(df):
    return sorted(((r.doc_id, [(s["start"], s["end"], s["kind"]) for s in r.spans]) for r in df.collect()), key=str)


@pytest.mark.parametrize("at_once", [5, 1 << 18])
def test_against_plain(spark, docs, monkeypatch, at_once):
    rng = random.Random(at_once)
    rows = [(100 + i, made_up(rng)) for i in range(150 if at_once > 5 else 25)]
    if at_once > 5:
        rows += [(i, t and t[:9000] + t[-9000:]) for i, t in edge_rows()]
    else:  # in this process, as workers would not see the smaller piece
        monkeypatch.setattr(secrets, "AT_ONCE", at_once)
        for _, text in rows:
            assert secrets.entropy_spans([text])[0] == sorted(plain_added(text))
        return
    got = rows_of(secrets.find_secrets(docs(rows).repartition(3)))
    assert got == sorted(((i, plain(t)[1]) for i, t in rows), key=str)
    assert {k for _, spans in got for *_, k in spans} == set(NAMES)


def test_query_on_a_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smaller one holds no secret
    got = sorted(tuple(r) for r in secrets.op12_secrets(spark, sf_dir).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect())
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        base, spans = plain(r.text)
        n = Counter(k for *_, k in base)
        want.append((r.doc_id, n["assign"], n["access"], n["hex"],
                     hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
    assert got == sorted(want) and any(w[1] for w in want)


def test_very_long_text(spark, docs):
    rng = random.Random(9)
    secret = "".join(rng.choice(WORD) for _ in range(600_000))
    got = rows_of(secrets.find_secrets(docs([(1, "a" * 700_000 + " " + secret + " token=" + secret)])))
    spans = got[0][1]
    assert (spans[0], spans[-1]) == ((0, 700_000, "hex"), (1_300_002, 1_900_008, "assign"))
    places = {i for start, end, _ in spans[1:-1] for i in range(start, end)}
    assert len(places) > 590_000 and min(places) >= 700_001 and max(places) <= 1_300_000


def test_sums_of_short_and_long_windows():
    rng = np.random.default_rng(3)
    symbols, runs = rng.integers(0, 4, 300), np.sort(rng.integers(0, 9, 300))
    for w in (1, 2, 7, 400):
        got = secrets.window_sums(symbols, runs, w)
        for t in range(300):
            inside = [symbols[i] for i in range(max(0, t - w + 1), t + 1) if runs[i] == runs[t]]
            assert got[t] == sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(inside).values())


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(7)
    for alphabet, size in ((WORD, 32), ("0123456789ABCDEF", 40), (WORD + "+/", 44)):
        strings = ["".join(rng.choice(alphabet) for _ in range(size)) for _ in range(500)]
        assert sum(map(bool, secrets.entropy_spans(strings))) > 490
    harmless = ["InternationalizationConfigurationManagerFactoryBean", "getUserAccountByIdentifierAndRegionCode2",
                "Donaudampfschifffahrtsgesellschaftskapitän", "0123456789" * 5, "1700000000000000000000000000", WORD,
                "very_long_snake_case_name_with_words_2024_v2", "/var/lib/Data/2024/12/Reports-Final/page10"]
    assert secrets.entropy_spans(harmless) == [[]] * len(harmless)
    # Without the allow-list some of them are reported.
    assert any(secrets.entropy_spans(["/usr/local/share/Documents/2024-report/Final_Version-v12"], allow=()))


def test_options(spark, docs):
    mine = secrets.CharacterClass("digits", "0-9", 12, 2.5, 1)
    text = "pin 926184730518 and token=abcdefgh1"
    got = rows_of(secrets.find_secrets(docs([(1, text)]), [mine], allow=()))
    assert got == [(1, [(4, 16, "digits"), (21, 36, "assign")])]
    assert rows_of(secrets.find_secrets(docs([(1, text)]), [])) == [(1, [(21, 36, "assign")])]
    with pytest.raises(ValueError):
        secrets.find_secrets(docs([(1, text)]), [mine, mine])
    assert secrets.find_secrets(docs([(1, text)]).limit(0)).collect() == []
