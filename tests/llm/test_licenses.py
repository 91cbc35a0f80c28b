"""License templates against regular expressions, whole texts, base columns against SQL, odd rows."""

import random
import re

import duckdb
import pytest

from docketspark.llm import licenses
from docketspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def pattern(markup):
    """The template as a regular expression over words that a space follows."""
    out, at = [], 0
    for m in re.finditer(r"<<(beginOptional|endOptional|var;[^>]*)>>|([^<]+)", markup):
        mark, text = m.groups()
        if mark == "beginOptional":
            out.append("(?:")
        elif mark == "endOptional":
            out.append(")?")
        elif mark:
            out.append(rf"(?:\S+ ){{0,{re.search(r'max=(\d+)', mark)[1]}}}")
        else:
            out.append("".join(re.escape(w) + " " for w in text.split()))
        at = m.end()
    assert at == len(markup)
    return re.compile("(?:^| )" + "".join(out))


def written(markup, rng, spoil):
    """A text that the template accepts; with `spoil`, one mandatory word is changed."""
    words, depth, skipped = [], 0, []
    for mark, text in re.findall(r"<<(beginOptional|endOptional|var;[^>]*)>>|([^<]+)", markup):
        if mark == "beginOptional":
            depth += 1
            skipped.append(rng.random() < 0.5)
        elif mark == "endOptional":
            depth -= 1
            skipped.pop()
        elif mark and not any(skipped):
            words += [(f"holder{i}", False) for i in range(rng.randint(0, int(re.search(r"max=(\d+)", mark)[1])))]
        elif not any(skipped):
            words += [(w, depth == 0) for w in text.split()]
    must = [i for i, (_, m) in enumerate(words) if m]
    words = [w for w, _ in words]
    if spoil:
        words[rng.choice(must)] = "changed"
    return " ".join(words)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_its_regular_expression(name):
    rng, markup = random.Random(name), licenses.TEMPLATES[name]
    s, p = licenses.Scanner({name: markup}, {}), pattern(markup)
    for turn in range(40):
        text = f"Before. {written(markup, rng, spoil=turn % 2 == 1)} after"
        shown = text.replace(" ", ", \n" if turn % 3 else " ").upper() if turn % 5 else text
        words = " ".join(w.decode() for w in licenses.WORD.findall(shown.encode().lower())) + " "
        assert bool(s.scan(shown.encode())[2]) == bool(p.search(words))
        assert turn % 2 == 1 or s.scan(shown.encode())[2] == {name}


def test_nested_regions_and_scores():
    s = licenses.Scanner({"t": "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;name=x;max=2>> e"}, {"p q": "l"})
    for text, want in {"a e": True, "a b d e": True, "a b c d e": True, "a b c e": True, "a b c d x y e": True, "a b c d x y z e": False, "e": False, "x a x e": True}.items():
        assert bool(s.scan(text.encode())[2]) == want, text
    score = lambda t: s.score(*s.scan(t.encode())[1:])
    assert score("nothing") == 0 < score("p q") == score("p q p q") < score("p q a e") < 1
    for bad in ("a <<beginOptional>>b", "a b<<endOptional>>", "<<var;name=x;max=2>> a"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


def test_base_columns_equal_sql(spark):
    got = {r["doc_id"]: r for r in QUERIES["op2_license_scan"](spark, DATA).collect()}
    rows = duckdb.execute(f"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM '{DATA}/documents.parquet'").fetchall()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, words in rows:
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r, places = got[i], [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted({x for _, x in at} | set(r["templates"]))) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert len(got) == len(rows) and any(r["templates"] for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT\tLicense"), (4, "é " * 300_000 + "under the MIT license"), (5, "mit license"), (5, "mit license")]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    out = licenses.license_scan(d).collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for r in out if r["doc_id"] in (1, 2)] == [(0, 0, None, "", 0.0)] * 2
    assert [r["first_word"] for r in out if r["doc_id"] == 4] == [300_002] and sum(r["doc_id"] == 5 and r["n_base"] == 1 for r in out) == 2 and len(out) == 6
    assert licenses.license_scan(d.limit(0)).count() == 0
