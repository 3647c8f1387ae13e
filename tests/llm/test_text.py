from __future__ import annotations

import itertools
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import chains, licenses, pii, pii_examples, quality, transcripts

SF = "/root/testdata/sf0.001"


def test_licenses_equal_sql(spark):
    got = [tuple(r) for r in licenses.op3_licenses(spark, SF).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(licenses.oracle()).fetchall()
    assert sorted(got) == sorted(want)


def test_licenses_awkward_rows(spark, docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (rows[1]["n_words"], rows[1]["n_base"], rows[1]["first_word"], rows[1]["labels"], rows[1]["score"]) == (0, 0, None, "", 0.0)
    assert rows[9]["base_labels"] == "mit" and rows[9]["score"] == 1.0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0
    text = "x y\nRedistribution and use in source & binary forms, with or without modification, are permitted provided that the following conditions are met: z"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, text.replace("forms", "f").replace("source", "s").replace("met", "m"))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["labels"], r[0]["base_labels"]) == ("bsd", "") and r[1]["labels"] == ""


@pytest.mark.parametrize("line, labels", [
    ("Licensed under CC BY-NC 4.0.", "cc"), ("Licensed under CC BY 4.0", "cc"), ("licensed under cc by-sa 3.0", "cc"), ("Licensed under CC BY-NC-ND 2.5", "cc"),
    ("This text is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc"), ("CC0 1.0 Universal", "cc"),
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under GPL-3.0-or-later", "gpl"),
    ("Released under the BSD 3-Clause License.", "bsd"), ("Licensed under the ISC License.", "isc"),
    ("Distributed under the Mozilla Public License 2.0", "mpl"), ("Licensed under MPL-2.0", "mpl"),
    ("Under the GNU Affero General Public License, version 3", "agpl,gpl"), ("Licensed under AGPL-3.0", "agpl"),
    ("under the GNU Lesser General Public License v2.1", "gpl,lgpl"), ("Licensed under LGPL 2.1", "lgpl"),
    ("We cc the report by mail; 4 copies, 0 replies.", ""), ("Licensed by the city, under the bridge.", ""),
])
def test_short_license_notices(spark, line, labels):
    r = licenses.scan(spark.createDataFrame([(1, f"Some words.\n{line}\nMore words.")], "doc_id long, text string")).first()
    assert (r["labels"], r["score"]) == (labels, 1.0 if labels else 0.0)


def reference_matches(text):
    """{label: containment} over all lines and all runs of words, one by one."""
    words = lambda t: re.findall("[0-9a-z]+", t.lower())
    out, all_words = {}, words(text)
    for label, template in licenses.TEMPLATES:
        want, n = set(words(template)), licenses.run_length(template)
        blocks = [set(words(line)) for line in text.split("\n")] + [set(all_words[k : k + n]) for k in range(len(all_words))]
        best = max(len(want & b) for b in blocks) / len(want)
        if best >= licenses.THRESHOLD - 1e-9:
            out[label] = max(best, out.get(label, 0))
    return out


def test_wrapped_license_notices(spark):
    rng, filler, texts = random.Random(5), "the of software and under license to in is this use copy 4 0 by".split(), []
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    for label, template in licenses.TEMPLATES:
        for width, lead in ((20, ""), (40, " * "), (72, "# ")):
            own = template.split()
            for lost in (0, len(own) // 10, len(own) // 4 + 1):
                left = [w for k, w in enumerate(own) if k not in rng.sample(range(len(own)), lost)]
                wrapped = [lead + x for x in textwrap.wrap(" ".join(left), width)]
                texts.append((label if not lost else None, "\n".join([some(rng.choice([3, 240, 255, 300])), *wrapped, some(9)])))
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for k, (label, text) in enumerate(texts):
        want, r = reference_matches(text), rows[k]
        assert set(r["labels"].split(",")) - {""} == set(want) | set(r["base_labels"].split(",")) - {""}
        assert r["n_base"] or r["score"] == pytest.approx(max(want.values(), default=0))
        assert label is None or label in r["labels"].split(",")


def reference_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    parts = ["1", "25", "4", "0", "@", "a", "b.c", ".", "-", " ", "+", "(", ")", "4111111111111111", "é", "\n", "٣"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == reference_spans(t)


def test_field_learns_its_table_and_leaves_clean_text_alone():
    field = pii.train(pii_examples.labelled())
    right = total = 0
    for text, spans in pii_examples.labelled():
        base, more = pii.found([text], field)[0]
        for kind, start, end in spans:
            total += 1
            right += any(k == kind and b < end and start < e for k, b, e in base + more)
        if not spans:
            assert not base + more
    assert right >= 0.9 * total
    for unseen, kind in (("please ring 555-987-6543 or wait", "phone"), ("mail to mary at test dot org", "email"), ("the ssn 321-54-9876 is mine", "ssn")):
        assert [x[0] for x in pii.found([unseen], field)[0][1]] == [kind]
    clean = ["Version 2.0, page 12 of 300, in 1999.", "no digits here at all", "we look at the dot and the com", "the General Public License, version 3."]
    assert all(not b + m for b, m in pii.found(clean, field))


@pytest.mark.parametrize("address", ["MARY AT TEST DOT ORG", "Mary At Test Dot Org", "mary[at]test[dot]org", "mary(at)test(dot)org", "MARY[AT]TEST[DOT]ORG", "mary.poe[at]mail[dot]test[dot]org", "mary [at] test [dot] org", "mary(at)test.org", "mary (at) test.org"])
def test_spelled_addresses_in_any_form(address):
    field = pii.train(pii_examples.labelled())
    for text in (f"mail to {address} or wait", f"the of {address}, and", f"write {address}"):
        (base, more), at = pii.found([text], field)[0], text.index(address)
        assert base + more == [("email", at, at + len(address))]
        assert pii.redact(text, base + more) == text.replace(address, "[EMAIL]")
    clean = ["LOOK AT THE DOT AND THE LINE", "Look At The Dot On The Map", "x[at] y(dot) z", "see f(at) or g[dot] there", "values[at][dot] of the"]
    assert all(not b + m for b, m in pii.found(clean, field))


#: Rows that the field never saw: other words, names and numbers.
HELD_OUT = """
you may ring the desk at [phone|7185550163] before nine
his mobile number is [phone|6465550177] if you must
phone [phone|(303) 555-0119] and ask for sue
fax it to [phone|404-555-0138] by friday
reach her on [phone|020 7946 0111] at lunch
dial [phone|1-888-555-0147] and hold
tel. [phone|206.555.0188] after noon
we are on [phone|+44 20 7946 0345] all day
text me at [phone|503 555 0172] later
send it to [email|peter at lake dot org] please
my address is [email|nora [at] river [dot] net] these days
WRITE TO [email|HANK AT STONE DOT COM] FOR IT
mail [email|rita(at)field(dot)edu] with it
ask [email|carl[at]shore[dot]io] about the rest
try [email|vera (at) cliff (dot) gov] or nobody
they use [email|omar at post dot wood dot org] for that
send a note to [email|lena@grove.example.net] soon
his ssn is [ssn|521-43-8765] as filed
social security no. [ssn|433 54 3937] on record
ssn [ssn|701234567] was on the card
the visa [card|4222222222222] was lost
charge [card|5105 1051 0510 5100] for it
card number [card|6011000990139424] was read out
the host [ip|10.20.30.40] went down
ping [ip|198.51.100.7] twice
from [ip|203.0.113.99] on tuesday
id 876543210 was not found
serial number 223344556 on the back
order 7185550163 left the shop
the account 665544332 is new
batch 6465550177 was cut
population of 83294633 in all
between 1914 and 1918 and again in 1939
version 4.12.1 came on 2021-03-04 at 09:15
pages 212 to 230 of volume 7
about 3,400,000 rows in 12.5 seconds
a score of 4:2 after 120 minutes
look at one dot on the screen
he stood at the dot and waited
isbn 978-0-306-40615-7 on the shelf
chapter 3, section 14.2, note 9
the ratio 16:10 and 1,024 by 768
key 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b of the box
room 2048 on floor 16 of 20
on 01/02/2003 it was 21.5 degrees
""".strip().splitlines()


def test_field_on_held_out_rows():
    model = pii.train(pii_examples.labelled())
    right = marked = true = 0
    wrong = []
    for text, spans in pii_examples.labelled(HELD_OUT):
        base, more = pii.found([text], model)[0]
        got, want = set(base + more), set(spans)
        right, marked, true = right + len(got & want), marked + len(got), true + len(want)
        if got != want:
            wrong.append((text, got, want))
    assert right >= 0.9 * marked and right >= 0.9 * true, wrong


def test_long_texts_of_numbers_take_bounded_memory():
    import tracemalloc

    model = pii.train(pii_examples.labelled(), rounds=20)
    rng = random.Random(1)
    text = " ".join(str(rng.randint(0, 99_999)) for _ in range(120_000))
    model.decode([["a"]])
    tracemalloc.start()
    pii.found([text], model)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_stretches_cover_each_word_once_and_keep_spans(monkeypatch):
    model = pii.train(pii_examples.labelled())
    rng = random.Random(2)
    items = ["12", "7 8 9", "x", "call 555-123-4567", "ssn 123-45-6789", "jane at example dot com", "3.5", "phone (555) 123-4567"]
    text = " ".join(rng.choice(items) for _ in range(3000))
    whole = pii.found([text], model)
    monkeypatch.setattr(pii, "STRETCH", 50)
    for stretch in pii.windows(text):
        assert len(stretch[0]) <= 50 + 2 * pii.OVERLAP
    own = [w for words, a, b in pii.windows(text) for w in words[a:b]]
    assert len(own) == len(set(own)) and own == sorted(own)
    assert pii.found([text], model) == whole and len(whole[0][1]) > 500


def test_emissions_equal_feature_weights():
    model = pii.train(pii_examples.labelled(), rounds=10)
    words = "call 555-123-4567 or jane at example dot com now, please 4111111111111111".split()
    assert np.allclose(model.emissions(words), model.weights[model.ids(words)].sum(1), atol=1e-5)


def test_op5_query_columns(spark):
    """Every contract column of the registered query from the plain patterns and the field."""
    import hashlib

    model = pii.train(pii_examples.labelled())
    told = lambda spans: ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pii.op5_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = reference_spans(docs[r["doc_id"]])
        more = pii.found([docs[r["doc_id"]]], model)[0][1]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest() and r["spans"] == told(base + more)
    assert any(r["n_email"] for r in rows)


def test_pii_awkward_rows(docs):
    rows = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert rows[1]["base"] == [] and [s["kind"] for s in rows[9]["base"]] == ["email", "phone"]
    red = pii.redacted(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert red.where("doc_id = 9").first()["text"] == "mail [EMAIL] or [PHONE], MIT License" and red.where("doc_id = 1").first()["text"] is None
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    first, steps = rng.normal(size=3), rng.normal(size=(3, 3))
    emit = [rng.normal(size=(n, 3)) for n in (1, 4, 0, 6, 2)]
    for e, path in zip(emit, chains.viterbi(emit, first, steps, cells=8), strict=True):
        score = lambda p: first[p[0]] + sum(e[k, s] for k, s in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(3), repeat=len(e)), key=score) if len(e) else ()
        assert tuple(path.tolist()) == best


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for k in range(600):
        good = k % 3 > 0
        w = [word() for _ in range(60)]
        rows.append((k, " ".join(w) + "." if good else rng.choice([" | ".join(w), "!! ".join(w).upper(), " ".join([w[0]] * 60)])))
        marks.append((k, int(good)))
    rows += [(9001, None), (9002, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (5, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r for r in quality.score_documents(docs, model).collect()}
    held = [k for k, _ in marks if out[k]["held_out"]]
    assert len(out) == 602 and 0.15 < len(held) / 600 < 0.35
    assert np.mean([out[k]["predicted"] == marks[k][1] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["doc_id"] for r in quality.keep_good(docs, model).collect()} == {k for k, r in out.items() if r["predicted"]}


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs, none)
    assert {r["score"] for r in quality.score_documents(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.score_documents(docs, quality.learn(docs, one)).collect()}) == 1
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_transcripts(spark):
    held = transcripts.op1_chat_format(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("n_right"), F.sum("n_lines")).first()
    assert held[0] / held[1] > 0.85
    z = spark.createDataFrame([(1, 0, "user", "hi <|x|>"), (1, 0, "user", "hi <|x|>"), (1, 1, "assistant", None), (None, 1, "user", "x"), (2, None, "bad", "y"), (3, 5, "user", "")], "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_transcripts(z)
    model = transcripts.train(raw)
    out = transcripts.parse(raw, model).collect()
    assert sorted(r["id"] for r in out) == [1, 2, 3] and not any("<|x|>" in r["rendered"] for r in out)
    assert [(t["role"], t["lines"]) for t in raw.where("id = 2").first()["turns"]] == [("other", 1)]
    assert transcripts.parse(raw.limit(0), transcripts.train(raw.limit(0))).count() == 0


def test_parts_of_a_long_conversation_are_one_chain(spark):
    rng = random.Random(1)
    said = lambda: "\n".join(rng.choice(["hi there.", "what is it?", "Yes", "<|x|> y", ""]) for _ in range(rng.randint(1, 3)))
    rows = [(1, k, rng.choice(["user", "assistant", "system", "tool", None]), said()) for k in range(5000)] + [(2, k // 3, "user", f"abc {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = transcripts.raw_transcripts(df)
    model = transcripts.train(raw)
    whole = {r["id"]: r for r in transcripts.parse(raw, model).collect()}
    assert sorted(whole) == [1, 2]
    for turns in (7, 100):
        parts = {}
        for r in transcripts.parse(transcripts.raw_transcripts(df, part_turns=turns), model).orderBy("id", "part").collect():
            parts.setdefault(r["id"], []).append(r)
        assert len(parts[1]) == -(-5000 // turns)
        for k, r in whole.items():
            assert "".join(x["rendered"] for x in parts[k]) == r["rendered"]
            assert sum((x["line_roles"] for x in parts[k]), []) == r["line_roles"] and sum((x["turn_roles"] for x in parts[k]), []) == r["turn_roles"]


def test_score_equals_rules_in_python(spark):
    """The compiled column against the kept rules, one by one, over the statistics."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    stats = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.statistics(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    for r in quality.score_documents(docs, model).collect():
        s = stats[r["doc_id"]]
        logit = model.intercept + sum(w for rule, w in model.rules if all(s[n] <= v if sign == "<=" else s[n] > v for n, sign, v in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


@pytest.mark.parametrize("line, word, rest", [("User: hi", "user", "hi"), ("[assistant] yes", "assistant", "yes"), ("<|system|> be", "system", "be"), ("### Response: x", "response", "x"), ("the time: now", "", "the time: now"), ("", "", "")])
def test_markers(line, word, rest):
    assert transcripts.marker(line) == (word, rest)


def test_chat_query_equals_all_paths(spark, tmp_path):
    """The query on short conversations, with columns whose names clash, against every path of states and turns put together by hand."""
    rng = random.Random(6)
    words = ["Hello there.", "What is it?", "fine", "Yes: see", "ok\nand more", "", "User of tools", "no marker here!"]
    rows = [(c, t, transcripts.ROLES[(t + c) % 3 if t else 0], rng.choice(words), "x", 1, "y") for c in range(40) for t in range(1 + c % 3)]
    rows += [(40, 0, "user", None, "x", 1, "y"), (41, 0, "wizard", "odd role", "x", 1, "y"), (42, None, "user", "no turn", "x", 1, "y"), (None, 0, "user", "no id", "x", 1, "y"), rows[3], rows[3]]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, id string, part int, marked string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    raw = transcripts.raw_transcripts(table).collect()
    counts = {}
    for r in raw:
        if zlib.crc32(str(r["id"]).encode()) % 4 == 2:
            continue
        states = transcripts.states_of([(t["role"], t["lines"]) for t in r["turns"]])
        keys = [("first", "", states[0]), *(("step", str(a), b) for a, b in itertools.pairwise(states)), *(("seen", f, s) for x, s in zip(r["text"].split("\n"), states, strict=True) for f in transcripts.features(x))]
        for k in keys:
            counts[k] = counts.get(k, 0) + 1
    model = transcripts.model_of(counts)
    got = {r["conv_id"]: r for r in transcripts.op1_chat_format(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(43)) == sorted(r["id"] for r in raw)
    for r in raw:
        lines = r["text"].split("\n")
        emit = model.lines(lines)
        score = lambda path: model.first[path[0]] + sum(model.steps[a, b] for a, b in itertools.pairwise(path)) + sum(emit[k, s] for k, s in enumerate(path))  # noqa: B023, E731
        best = max(itertools.product(range(len(transcripts.STATES)), repeat=len(lines)), key=score)
        turns = []
        for line, s in zip(lines, best, strict=True):
            role, opens = transcripts.STATES[s]
            if opens or not turns:
                turns.append((role, [transcripts.marker(line)[1]]))
            else:
                turns[-1][1].append(line)
        true = [t["role"] for t in r["turns"] for _ in range(t["lines"])]
        found = got[r["id"]]
        assert found["text"] == "".join(f"<|{role}|>\n" + "\n".join(x).replace("<|", "< |") + "\n<|end|>\n" for role, x in turns)
        assert (found["roles"], found["n_turns"], found["n_lines"]) == (",".join(role for role, _ in turns), len(turns), len(lines))
        assert found["n_right"] == sum(transcripts.STATES[s][0] == t for s, t in zip(best, true, strict=True)) and found["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)
