import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import encoding, feistel, leakage, pii

KEY = b"test"
NAMES = pii.Names.fit(["Ana Bramford", "Leo Stonefield", "Mia Oakfield", "Kim Lakefield"], ["the field is blank, Ana said", "a field of the field list on Thursday", "my field", "Thursday it was"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**12), st.data())
def test_feistel_is_a_permutation(domain, data):
    x = data.draw(st.integers(0, domain - 1))
    y = feistel.permute(x, domain, KEY)
    assert 0 <= y < domain and feistel.permute(y, domain, KEY, invert=True) == x


def test_small_domain_is_bijective():
    assert sorted(feistel.permute(i, 37, KEY) for i in range(37)) == list(range(37))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789AZaz -./", max_size=20))
def test_formats_survive(text):
    out = feistel.permute_format(text, KEY)
    kind = lambda s: "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in s)
    assert kind(out) == kind(text) and feistel.permute_format(out, KEY, invert=True) == text


def test_dates_round_trip():
    d = datetime.date(1980, 2, 29)
    assert feistel.permute_date(feistel.permute_date(d, KEY), KEY, invert=True) == d


CASES = [
    ("Write to a.b+c@mail.x.example today", {"email"}), ("a.b (at) x dot org on the desk", {"email"}), ("a@b@c and @handle and pkg@1.2.3", set()), ("Package @acme/sync@2.16.2 is pinned", set()),
    ("Call 212-555-0123 ext. 44 now", {"phone"}), ("Tel +44 (0)7700 900 911", {"phone"}), ("Text 2125550123 if", {"phone"}), ("job 2125550123 in queue", set()), ("run 5562522657.", set()), ("Phone +33 1 99 00 58 96", {"phone"}),
    ("my SSN: 666443123", {"identity_number"}), ("They wanted 666-44-3123 before", {"identity_number"}), ("Invoice 2149-53-1174", set()), ("order 666-44-3123", set()), ("tax id 985-16-5389 before", {"identity_number"}), ("passport no. X24796583", {"identity_number"}), ("NI no. QQ 56 73 79 D", {"identity_number"}), ("licence Z367-6789-6665", {"identity_number"}), ("XXX-XX-XXXX", set()),
    ("go to 12 Old Thorn Lane, Flat 3", {"street_address"}), ("Lane 58 of the queue", set()), ("The 1284 Drive folders", set()), ("The 95 apparently Drive folders", set()), ("the Stothby Street Layout", set()), ("61 rue du Bac", {"street_address"}), ("Calle Mayor 21, 5º", {"street_address"}), ("Gartenstraße 7", {"street_address"}), ("from 42 hill rd", {"street_address"}),
    ("I am Ana Stonefield, admin", {"person_name"}), ("STONEFIELD, LEO", {"person_name"}), ("This is L. Stonefield", {"person_name"}), ("Leo A. Oakfield", {"person_name"}), ("Stonefield, L. from", {"person_name"}), ("the Oakfield product", set()), ("Ana Lee wrote", {"person_name"}), ("ANA LEE", {"person_name"}), ("Ana O'Brien's desk", {"person_name"}), ("Ana Thursday", set()), ("Ana wrote", set()), ("Ana. Lee", set()), ("ANA wrote", set()), ("Ana opened a field", set()), ("ana.stonefield@x.org", {"email"}), ("", set()),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_finding(text, kinds):
    assert {k for _, _, k in pii.find(text, NAMES)} == kinds


def test_redaction_changes_nothing_else_and_links():
    text = "Ana Oakfield, call 212-555-0123 or (212) 555 0123, id 666-44-3123."
    out, kinds = pii.redact(text, NAMES, KEY)
    assert re.sub(r"\[[^\]]*\]", "#", out) == "#, call # or #, id #." and kinds == ["person_name", "phone", "phone", "identity_number"]
    a, b = re.findall(r"\[PHONE ([^\]]*)\]", out)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and "555" not in (a, b)
    assert pii.redact(None, NAMES, KEY) == (None, []) and pii.redact("plain", NAMES, KEY) == ("plain", [])
    assert pii.redact("Oakfield, Ana", NAMES, KEY)[0] == pii.redact("ana OAKFIELD", NAMES, KEY)[0]


PHONES = ["+353 1 234 5678", "+420 222 555 010", "+1 212 555 0123", "+44 (0)7700 900 911", "+7 495 555 01 23", "+49 30 555 0123", "212-555-0123", "1-212-555-0123", "030 5550 1234"]


@pytest.mark.parametrize("number", PHONES)
def test_country_codes_and_rules_survive(number):
    out = pii.placeholder("phone", number, KEY)[7:-1]
    assert re.sub(r"\d", "9", out) == re.sub(r"\d", "9", number) and pii.valid("phone", out) == pii.valid("phone", number) and out != number
    if number[0] == "+":
        n = pii.country_code(re.sub(r"\D", "", number))
        assert re.sub(r"\D", "", out)[:n] == re.sub(r"\D", "", number)[:n]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9 - 1))
def test_pseudonyms_pass_the_rules_that_the_number_passes(n):
    ssn = f"{n:09d}"
    ssn = f"{ssn[:3]}-{ssn[3:5]}-{ssn[5:]}"
    out = pii.pseudonym("identity_number", ssn, KEY)
    assert pii.valid("identity_number", out) == pii.valid("identity_number", ssn) and pii.pseudonym("identity_number", out, KEY, invert=True) == ssn


def test_country_codes():
    assert [pii.country_code(d) for d in ("14155550123", "74955550123", "4477009001", "35312345678", "42022255501", "21612345678")] == [1, 1, 2, 3, 3, 3]


def test_initials_link_to_full_names():
    tag = lambda t: re.search(r"\[PERSON_NAME ([^]]*)\]", pii.redact(t, NAMES, KEY)[0])[1]
    full = tag("Leo Stonefield")
    assert full == tag("STONEFIELD, LEO") == tag("leo stonefield") and full.startswith(tag("L. Stonefield") + "-") and tag("L. Stonefield") == tag("Stonefield, L. from")
    assert tag("Mia Stonefield").split("-")[0] == full.split("-")[0] and tag("Mia Stonefield") != full and len(full.split("-")[0]) == 12


def test_dates_of_birth_only_where_asked():
    text = "Born 1980-02-29, due 2026-03-01, DOB: 1999/12/31, born 1980-13-01"
    assert pii.redact(text, NAMES, KEY) == (text, [])
    out, kinds = pii.redact(text, NAMES, KEY, dates=True)
    assert kinds == ["birth_date"] * 2 and "due 2026-03-01" in out and "1980-13-01" in out
    day = datetime.date.fromisoformat(re.search(r"\[BIRTH_DATE ([\d-]+)\]", out)[1])
    assert feistel.permute_date(day, KEY, invert=True) == datetime.date(1980, 2, 29)


def test_found_hangs_on_the_redaction(spark, monkeypatch):
    from tallyloom.llm import queries

    seen = queries.p1_found(spark, "/root/testdata/sf0.001").limit(1).count()
    monkeypatch.setattr(pii, "redacted", lambda rows, names, key, table_name, *_: rows.select(F.lit(table_name).alias("table_name"), "record_id", F.array().cast("array<string>").alias("pii_types")))
    assert seen == 1 and queries.p1_found(spark, "/root/testdata/sf0.001").count() == 0


def test_redaction_in_spark(spark):
    long = "word " * 50_000 + "a@b.org"
    df = spark.createDataFrame([("1", "a@b.org", "t"), ("2", None, None), ("3", "", ""), (None, "a@b.org", ""), ("4", long, "x"), ("1", "a@b.org", "t")], "rid string, body string, text string")
    rows = pii.redacted(df, NAMES, KEY, "tab", "rid", "body").collect()
    assert len(rows) == 5 and {(r["record_id"], r["text"] is None) for r in rows} >= {("2", True), ("3", False)}
    assert {tuple(r) for r in pii.types_found(pii.redacted(df, NAMES, KEY, "tab", "rid", "body")).collect()} == {("tab", "1", "email"), ("tab", "4", "email")}
    assert pii.redacted(df.limit(0), NAMES, KEY, "tab", "rid", "body").count() == 0


def test_names_without_labels(spark):
    df = spark.createDataFrame([(("x", (None,)),)], "r struct<a:string,target:struct<name:string>>").select(F.struct(F.struct(F.col("r.target.name")).alias("customer")).alias("target"))
    assert pii.fit_names(df) == pii.Names()


# Problem 9


def split_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_leaks(docs, items, run):
    out = set()
    for d, t in docs:
        w = split_words(t)
        for i, u in items:
            v = split_words(u)
            size = min(run, len(v))
            grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            if size >= min(run, leakage.SHORT) and any(tuple(v[k : k + size]) in grams for k in range(len(v) - size + 1)):
                out.add((d, i, "run" if len(v) >= run else "whole"))
    return out


def brute_near(docs, items, run, share):
    out = set()
    for d, t in docs:
        w = split_words(t)
        for i, u in items:
            v = split_words(u)
            size = min(leakage.WINDOW, len(v))
            for s in range(-len(v), len(w) + 1) if size >= run else ():
                near = [x in w[max(0, k + s - leakage.NEAR) : max(0, k + s + leakage.NEAR + 1)] for k, x in enumerate(v)]
                if any(sum(near[a : a + size]) >= size * share for a in range(len(v) - size + 1)):
                    out.add((d, i))
                    break
    return out


def test_leaks_match_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "a " * 30)]
    docs = []
    for d in range(80):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if d % 3 == 0:
            v = split_words(items[rnd.randrange(12)][1])
            a = rnd.randrange(len(v))
            w[5:5] = v[a : a + rnd.randrange(1, 25)]
        docs.append((d, ", ".join(w).upper() if d % 2 else " - ".join(w)))
    docs += [(200, None), (201, ""), (202, "A a! " * 20), (None, "w1"), (203, docs[0][1])]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), run=6)
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in rows} == brute_leaks([x for x in docs if x[0] is not None], items, 6) and len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    assert all(r["run_words"] >= (6 if r["kind"] == "run" else 5) and r["near_words"] >= r["run_words"] for r in rows)


def test_near_passages_match_brute_force(spark, monkeypatch):
    """Passages with words changed, dropped and put in, so that few words in a row agree."""
    monkeypatch.setattr(leakage, "WINDOW", 12)
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(8, 40)))) for i in range(10)] + [(90, None), (91, "w1 w2"), (92, "a " * 30)]
    docs = []
    for d in range(70):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 50))]
        if d % 2:
            v = split_words(items[rnd.randrange(10)][1])
            for k in range(rnd.randrange(3), len(v), rnd.randrange(4, 7)):
                v[k : k + 1] = rnd.choice([[], ["other"], v[k : k + 1] + ["more"]])
            w[3:3] = v
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "A a! " * 20), (203, docs[1][1])]
    rows = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), run=8, near_share=0.75).collect()
    near = brute_near(docs, items, 8, 0.75)
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] != "whole"} == near | {x[:2] for x in brute_leaks(docs, items, 8) if x[2] == "run"}
    assert sum(r["kind"] == "near" for r in rows) > 10


def test_index_grows_by_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon zeta {i} tail") for i in range(20)] + [(None, "alpha"), (99, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "gamma delta epsilon zeta 7 tail", 0)], "item_id long, text string, doc_id int")
    index = leakage.PositionalIndex(spark, str(tmp_path)).append(docs.where("doc_id < 5"))
    assert leakage.leaks(docs, items, run=6, index=index).count() == 0
    index.append(docs).append(docs)
    assert [(r["doc_id"], r["run_words"]) for r in leakage.leaks(docs, items, run=6, index=index).collect()] == [(7, 6)]
    assert index.documents_.read().count() == 20 and index.postings_.read().where("term = 'alpha'").count() == 20


def test_large_held_out_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_CHARACTERS", 10)
    with pytest.raises(ValueError):
        leakage.held_out(spark.createDataFrame([(1, "more than ten characters")], "item_id long, text string"))


def test_leaks_of_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(d, i).count() == 0 and leakage.leaks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), i).count() == 0


# Problem 10

CLEAN = ["Le café a été fermé à midi.", "Die Tür wäre schön, für heute genügt es.", "Ошибка повторяется каждый вечер", "Señal perdida — “naïve” rôle", "価格を変更しました。", "plain ascii text", "└── a.json"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, f"{t} {i}") for i, t in enumerate(CLEAN * 40)] + [(None, None), (9_999, "")], "doc_id long, text string")
    return encoding.fit(docs)


@pytest.mark.parametrize("reading", ["cp1252", "latin1", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trips(model, reading, times):
    decoder, tried = encoding.Decoder(model), 0
    table = {b: c for c, b in encoding.byte_table(reading).items()}
    for text in CLEAN[:4]:
        bad = text
        for _ in range(times):
            bad = "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in bad.encode())
        got, runs, _, _ = decoder.restore(bad)
        assert runs > 0
        tried += got == text
    assert tried >= (4 if times == 1 else 2)


def test_clean_and_quoted_texts_stay(model):
    d = encoding.Decoder(model)
    for t in [*CLEAN, "", "we see “Ã©” where the letter é belongs", "report the sign � in file 3", "prints â‚¬ instead of the euro sign"]:
        assert d.restore(t)[:2] == (t, 0), t


def test_lost_bytes(model):
    d = encoding.Decoder(model)
    assert d.restore("Le caf� ferm�")[0] == "Le café fermé"
    text, runs, open_, _ = d.restore("zz�zz")
    assert (text, runs, open_) == ("zz�zz", 1, 1)


def test_lost_bytes_are_wildcards_of_the_lattice(model, monkeypatch):
    """Marks of several lost bytes stand for one to so many characters; without paths nothing is filled."""
    d = encoding.Decoder(model)
    assert d.restore("Ошиб��а повторяется")[0] == "Ошибка повторяется" and d.restore("Die T��r w�re sch���n")[0] == "Die Tür wäre schön"
    monkeypatch.setattr(encoding, "BEAM", 0)
    assert d.fill("caf�") is None


@pytest.mark.parametrize("spread", [1, 40])
def test_answers_do_not_depend_on_repetition(spark, spread):
    """The same corpus once, ten times and a hundred times gives the same model and so the same answers."""
    base = [(f"{t} {i % spread}", f"desk/{i % 5}") for i, t in enumerate(CLEAN * 12)] + [(f"a small cafΘ here {i}", "desk/7") for i in range(2)] + [("plain cafÃ©", None), (None, "desk/1"), ("", "desk/1")]
    found, models = [], []
    for times in (1, 10, 100):
        docs = spark.range(times).crossJoin(spark.createDataFrame([(i, *r) for i, r in enumerate(base)], "k long, text string, source string")).select(F.col("k").alias("doc_id"), "text", "source")
        fitted = encoding.fit(docs)
        models.append((fitted.words, fitted.pairs, fitted.contexts, fitted.known))
        found.append({(r["doc_id"], r["restored"]) for r in encoding.repaired(docs, fitted).distinct().collect()})
    assert models[0] == models[1] == models[2] and found[0] == found[1] == found[2] and found[0]


def test_repair_in_spark(spark, model):
    bad = "Le cafÃ© a Ã©tÃ©"
    df = spark.createDataFrame([(1, bad, 0), (2, CLEAN[0], 0), (3, None, 0), (4, "", 0), (5, "x " * 100_000 + bad, 0), (1, bad, 0)], "doc_id long, text string, restored int")
    rows = encoding.repaired(df, model).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 5] and rows[0]["restored"] == "Le café a été"
    assert encoding.repaired(df.limit(0), model).count() == 0


def _garble(text, written, read):
    return "".join(chr(b) if b < 128 else {v: k for k, v in encoding.byte_table(read).items()}.get(b, chr(b)) for b in text.encode(written))


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp1251")])
@pytest.mark.parametrize("copies", [True, False])
def test_damage_of_a_third_of_the_rows_is_found(spark, written, read, copies):
    """One garbled thread in copies, or one source garbled as a whole, holds far more rows than the clean form."""
    german = "Die Tür wäre schön, für heute genügt größere Mühe."
    clean = [(i, f"Ticket {i}: {german}", f"desk/{i % 9}") for i in range(150)] + [(1_000 + i, f"Case {i}: {CLEAN[i % 4]}", f"desk/{i % 7}") for i in range(450)]
    bad = [(5_000 + i, _garble(german if copies else f"Thread {i}: {german}", written, read), "import/old") for i in range(1_500)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string, source string")
    rows = {r["doc_id"]: r["restored"] for r in encoding.repaired(docs, encoding.fit(docs)).collect()}
    assert set(rows) == {i for i, _, _ in bad}
    assert all(rows[i] == (german if copies else f"Thread {i - 5_000}: {german}") for i, _, _ in bad)
