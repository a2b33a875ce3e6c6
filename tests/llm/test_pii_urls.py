"""PII surrogates and URL filters."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from basin.llm import pii, queries, url_filter
from tests.llm.helpers import empty, odd_documents, rows, with_extra_columns

KEY = "k"
FOUND = (r"[\w.+-]+@[\w-]+\.[\w.-]+\w|\+1 \(\d+\) \d+-\d+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|(?<=password=)\w+|(?<=token = \")\w+")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def replaced(spark, *texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_pii(df, key).orderBy("doc_id").collect()]


def test_formats_types_and_coreference(spark):
    out = replaced(spark, "Mail Anna.S@Mail.Example.com or anna.s@mail.example.com, call +1 (017) 555-7713 / +1 017 555 7713",
                   "card 4111 1111 1111 1111, 4111111111111111, ip 10.0.0.1, ssn 123-45-6789", 'password=f2f5acd241f026fd29 token = "AbC123xyz789QQ"')
    a, b = re.findall(r"[\w.]+@[\w.]+", out[0])
    assert a.lower() == b and a != b and a.endswith(".com") and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", a)
    p, q = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) / (\+1 \d{3} \d{3} \d{4})", out[0]).groups()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713"
    c, d = re.search(r"card (4\d{3} \d{4} \d{4} \d{4}), (4\d{15}),", out[1]).groups()
    assert c.replace(" ", "") == d != "4111111111111111" and luhn(d)
    assert all(0 < int(x) < 256 for x in re.search(r"ip (\S+),", out[1]).group(1).split("."))
    assert re.search(r"ssn \d{3}-\d{2}-\d{4}$", out[1]) and "123-45-6789" not in out[1]
    assert re.fullmatch(r'password=[0-9a-f]{18} token = "[A-Z][a-z][A-Z]\d{3}[a-z]{3}\d{3}[A-Z]{2}"', out[2])


def test_names_keep_gender_script_case_and_person(spark):
    out = replaced(spark, "Mrs. Anna Schmidt; Anna Schmidt; Mrs. Schmidt; MR. x", "John Smith and Mr. Smith, Анна Иванова, Μαρία Παππά")
    whole, again, family = re.match(r"Mrs\. (\w+ \w+); (\w+ \w+); Mrs\. (\w+);", out[0]).groups()
    assert whole == again and whole.split()[1] == family and "Schmidt" not in out[0] and whole[0].isupper()
    assert whole.split()[0].lower().endswith(tuple(pii.ENDINGS["latin"]["f"]))
    given, family = re.match(r"(\w+) (\w+) and Mr\. \2,", out[1]).groups()
    assert given.lower().endswith(tuple(pii.ENDINGS["latin"]["m"]))
    assert re.search(r", [А-Я][а-я]+ [А-Я][а-я]+, [Α-Ω][α-ωά-ώς]+ [Α-Ω][α-ωά-ώς]+$", out[1])


def test_long_names_initials_and_stacked_titles_go_whole(spark):
    out = replaced(spark, "Dr. Anna Maria Schmidt met Mrs. Schmidt", "John Paul Jones and Mr. Jones", "John F. Kennedy, Mr. J.F. Kennedy",
                   "Prof. Dr. Anna Schmidt; Frau Dr. Schmidt", "Prof. Dr. who", "Mr. И. Иванов")
    family = re.fullmatch(r"Dr\. \w+ \w+ (\w+) met Mrs\. \1", out[0]).group(1)
    assert re.fullmatch(r"John Paul Jones and Mr\. Jones", out[1]) is None and re.fullmatch(r"\w+ \w+ (\w+) and Mr\. \1", out[1])
    assert re.fullmatch(r"\w+ ([A-Z])\. (\w+), Mr\. [A-Z]\.\1\. \2", out[2]) and "F." not in out[2]
    assert re.fullmatch(rf"Prof\. Dr\. \w+ {family}; Frau Dr\. {family}", out[3]) and out[4] == "Prof. Dr. who"
    assert re.fullmatch(r"Mr\. [А-Я]\. [А-Я][а-я]+", out[5]) and "И." not in out[5]
    assert not re.search("Anna|Maria|Schmidt|John|Paul|Jones|Kennedy|Иванов", " ".join(out))


def test_upper_case_hexadecimal_stays_so(spark):
    out = replaced(spark, *[f'TOKEN = "9233A8EC{i:04X}B7D1F02C"' for i in range(20)])
    assert len(set(out)) == 20 and all(re.fullmatch(r'TOKEN = "[0-9A-F]{20}"', x) and "9233A8EC" not in x for x in out)


def test_another_key_gives_other_surrogates_and_the_same_key_the_same(spark):
    text = "a.b@c.org 10.1.2.3"
    assert replaced(spark, text) == replaced(spark, text) != replaced(spark, text, key="other")


def test_clean_text_is_left_alone(spark):
    clean = ["Section 3.2 of 2020, 1,234 units; 12 345.", "token of thanks: great", "password: required", "e.g. 1.2.3", "Dr. who? M. Ed"]
    assert replaced(spark, *clean) == clean


def test_distinct_entities_stay_distinct(spark):
    """Short entities collide often; the redraws must end with a one-to-one table that names no entity."""
    ents = spark.createDataFrame([("secret_hex", f"{i:02x}") for i in range(0, 120)] + [
        ("given_f_latin", f"name{i}") for i in range(1500)], "kind string, canon string")
    table = pii.surrogates(ents, KEY).collect()
    assert len(table) == 1620 == len({(r.kind, r.surrogate) for r in table})
    assert not {(r.kind, r.surrogate) for r in table} & {(r.kind, r.canon) for r in table}


def test_against_brute_force_on_documents(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.QUERIES["op6_pii"](spark, sf_dir).collect()
    assert len(out) == len(before)
    table = {}
    for r in out:
        old, new = re.findall(FOUND, before[r.doc_id]), re.findall(FOUND, r.text)
        assert len(old) == len(new) == r.n_entities
        assert re.split(FOUND, before[r.doc_id]) == re.split(FOUND, r.text)
        for a, b in zip(old, new):
            assert a != b and table.setdefault(a, b) == b and len(a) == len(b) or a.count(".") == 3
    assert len(set(table.values())) == len(table) and not set(table) & set(table.values())


def test_surrogates_end_where_a_format_has_few_values(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    out = replaced(spark, "_@a.com", "_@e.com", "-@0.com", " ".join(f"{c}@{d}.org" for c in letters for d in letters),
                   " ".join(f"password=-------{i}" for i in range(10)))
    addresses = [*out[:3], *out[3].split()]
    assert len(set(addresses)) == len(addresses) == 3 + 36 * 36
    before = {f"{c}@{d}.org" for c in letters for d in letters}
    assert not before & set(addresses) and all(re.fullmatch(pii.EMAIL, a) for a in addresses)
    assert len({a.split("@")[0] for a in out[3].split()}) == len({a.split("@")[1] for a in out[3].split()}) == 36
    secrets = out[4].split()
    assert len(set(secrets)) == 10 and all(s.startswith("password=-------") for s in secrets)
    assert not set(secrets) & {f"password=-------{i}" for i in range(10)}


def test_entities_that_cannot_be_told_apart_are_named(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ROUNDS", 2)
    ents = spark.createDataFrame([("domain", c) for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, canon string")
    with pytest.raises(RuntimeError, match="domain a"):
        pii.surrogates(ents, KEY)


def test_particles_and_secrets_without_digits(spark):
    out = replaced(spark, "Anna de Vries and Mrs. de Vries, Dr. Hans van der Berg", "password=correcthorsebattery",
                   "order 1234567890123456", "Anna of it", "password=short")
    family = re.fullmatch(r"\w+ de (\w+) and Mrs\. de \1, Dr\. \w+ van der \w+", out[0]).group(1)
    assert family != "Vries" and "Berg" not in out[0] and "Anna" not in out[0]
    assert re.fullmatch("password=[a-z]{19}", out[1]) and "horse" not in out[1]
    assert re.fullmatch(r"order 1\d{15}", out[2]) and out[2] != "order 1234567890123456"
    assert out[3:] == ["Anna of it", "password=short"]


def test_pii_odd_rows(spark):
    docs = with_extra_columns(odd_documents(spark, ["x@y.org " * 3000, "x@y.org", "x@y.org"]))
    got = pii.replace_pii(docs, KEY)
    assert got.columns == [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    counts = {}
    for r in got.collect():
        counts.setdefault(r.doc_id, []).append((r.n_entities, r.text))
    assert counts[2] == [(0, None)] and counts[3] == [(0, "")] and len(counts[6]) == 2 and len(counts[None]) == 1
    assert counts[100][0][0] == 3000 and counts[101] == counts[102] and "x@y.org" not in counts[100][0][1]
    assert rows(pii.replace_pii(empty(docs), KEY)) == []


PAGES = [
    (1, "http://A.example.com/x", "<link rel='canonical' href='http://z.com/de/9'>"),
    (2, "https://n.net/q?a=1#f", '<meta http-equiv="refresh" content="0; url=http://a.example.com/x">'),
    (3, "http://b.org/k", '<LINK href="/es/1" rel=canonical>'), (4, "http://www.example.org/es/2", None),
    (5, None, "<link rel=canonical href=http://z.com/de/9>"), (6, "noscheme", None), (7, "http://www.example.org/en/12", "x"),
    (8, "http://m.fr.com/fr/1", '<link rel="canonical" href="http://z.com/de/9">'),
    (9, "http://k.net", '<link rel="canonical" href="u/v">'), (9, "http://k.net", '<link rel="canonical" href="//n.net/q?a=1">'),
    (10, "ftp://n.net/q?a=1", ""), (11, "http://notorg/es/", None), (12, "http://other.net/", '<link rel="stylesheet" href="http://z.com/de/9">'),
    (None, "http://z.com/de/", None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_redirect_equivalence_with_allow_precedence(spark, pages, tmp_path):
    verdict = {r.page_id: r.verdict for r in url_filter.judge(with_extra_columns(pages), queries.RULES).collect()}
    assert verdict[1] == verdict[2] == verdict[9] == verdict[10] == "block"  # aliases of a blocked address
    assert verdict[8] == "allow" and verdict[3] == "allow"  # explicit rules come first
    assert verdict[5] == verdict[6] == verdict[11] == verdict[12] == "allow"
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE["op2_url_filter"]).fetchall(), key=repr)
    assert rows(queries.QUERIES["op2_url_filter"](spark, str(tmp_path))) == want
    assert rows(url_filter.judge(empty(pages), queries.RULES)) == []


LINKED = [  # page url, html, the address its link means (null: none)
    ("http://k.net", '<link rel=canonical href="u/v">', "k.net/u/v"), ("http://k.net/a/b?x=1", "<link rel='canonical' href='?x=2'>", "k.net/a/b?x=2"),
    ("http://k.net/a/b/c", '<link href="../d" rel="canonical nofollow">', "k.net/a/d"), ("http://k.net/a/b", '<link rel="canonical" href="./">', "k.net/a/"),
    ("http://k.net/a/b", '<link rel="canonical" href="../../../../x/./y/..">', "k.net/x/"),
    ("http://k.net/a", '<link rel="canonical" href="/q?a=1&amp;b=2#f">', "k.net/q?a=1&b=2"),
    ("http://k.net/a", '<!-- <link rel="canonical" href="/no"> -->', None), ("http://k.net/a", '<!-- x <link rel="canonical" href="/no">', None),
    ("http://k.net/a", '<meta http-equiv="Refresh" content="0; URL=\'http://M.net\'">', "m.net/"),
    ("http://k.net/a", '<meta content="5;url=b" http-equiv=refresh>', "k.net/b"), ("http://k.net/a", '<link rel="canonical" href="mailto:x@y.z">', None),
    ("http://k.net/a", '<link rel="canonical" href=" //o.net/p ">', "o.net/p"), ("http://k.net/a?b", '<link rel="canonical" href="#top">', "k.net/a?b"),
    ("http://k.net/a", '<link rel="alternate" href="/no">', None), ("http://k.net/a", '<link title="a > b" rel="canonical" href="/yes">', "k.net/yes")]


@pytest.mark.parametrize("at,page,want", LINKED)
def test_links_are_resolved(spark, at, page, want):
    got = url_filter.alias_links(spark.createDataFrame([(at, page)], "url string, html string")).collect()
    assert [r.b for r in got] == ([want] if want else [])


def test_chains_of_redirects_against_sql(spark, sf_dir, tmp_path):
    """Every page of the table links to another one: long chains, stars and blocked ends."""
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    linked = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", """CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN
        concat('http://site', page_id % 50, '.net/a/b/', page_id) WHEN 2 THEN concat('http://com/de/', page_id) ELSE concat('http://h', page_id % 90,
        '.com/x/', page_id, '?q=', page_id % 3) END AS url""", f"""concat('<html><!-- <link rel=canonical href="/de/9"> -->', CASE page_id % 5
        WHEN 0 THEN concat('<link rel="canonical" href="http://h', (page_id + 1) % 90, '.com/x/', (page_id + 1) % {n}, '?q=', (page_id + 1) % 3, '">')
        WHEN 1 THEN '<link rel=canonical href="../y/./z">' WHEN 2 THEN concat('<meta http-equiv=refresh content="0; url=http://COM/de/', page_id + 2, '">')
        WHEN 3 THEN '<link rel=canonical href="?p=1&amp;r=2">' ELSE '' END, '</html>') AS html""")
    odd = spark.createDataFrame([(100_000 + i, at, page) for i, (at, page, _) in enumerate(LINKED)], "page_id long, url string, html string")
    linked.unionByName(odd).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLE["op2_url_filter"]).fetchall(), key=repr)
    got = queries.QUERIES["op2_url_filter"](spark, str(tmp_path))
    assert rows(got) == want and got.filter("rule IS NULL AND verdict = 'block'").count() > 10


def test_joined_rules_equal_inline_rules(spark, pages):
    rules = queries.RULES + [("block", "net", "/"), ("allow", "n.net", "/q"), ("block", "k.net", "")]
    urls = pages.select("page_id", "url", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"))
    urls = urls.filter("page_id <> 9")
    assert rows(url_filter.matched(urls, rules, ["page_id"])) == rows(url_filter.matched(urls, rules, ["page_id"], inline_rules=0))


def test_url_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(con.execute(queries.ORACLE["op2_url_filter"]).fetchall(), key=repr)
    assert rows(queries.QUERIES["op2_url_filter"](spark, sf_dir)) == want
