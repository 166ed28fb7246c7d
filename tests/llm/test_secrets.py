import hashlib
import random
import re

from shelfwise.llm.secrets import Value, assignments, find_secrets, pairs, redact_secrets, spans_of, valued
from tests.llm.helpers import SCHEMA, frame


def plain(text):
    text = text or ""
    out = []
    key = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for k, p, n in ((0, key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), (1, "(AKIA[A-Z0-9]+)", 16), (2, "([0-9a-f]+)", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[1]) >= n]
    return sorted(out)


def texts():
    rng = random.Random(5)
    parts = ["password", "passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh1", "short", "AKIA", "AKIAABCDEFGHIJKL12", "deadbeef" * 4, "0123456789abcdef" * 3, "é", "ſecret", "toKen", "\n", "x", "key", "name = "]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(600)]


def test_base_equals_plain_version(spark):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts())]
    joined = lambda x: ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in x)
    for r in find_secrets(frame(spark, rows)).collect():
        want = plain(rows[r.doc_id][1])
        counts = [sum(x[1] == k for x in want) for k in range(3)]
        assert [r.n_assign, r.n_access, r.n_hex] == counts, rows[r.doc_id][1]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= {*r.spans.split(","), ""}


def found(text):
    return [text[a:b] for a, k, b in spans_of(text) if k == 3]


def test_names_and_constants():
    assert found('client_auth_key = "Zx81kQpT77vbNw02"') == ["Zx81kQpT77vbNw02"]
    assert found('raw = "Zx81kQpT77vbNw02"\nSIGNATURE_KEY = raw\n') == ["Zx81kQpT77vbNw02"]
    assert found('a = "Zx81kQpT"\nb = "77vbNw02"\nprivate_access_key = a + b') == ["Zx81kQpT", "77vbNw02"]
    assert found('"credential": "hR7tQ2mW9xLp4c"') == ["hR7tQ2mW9xLp4c"]
    assert found("private_auth_key = your-key-here-please") == []
    assert found("colour = Zx81kQpT77vbNw02") == []
    assert found("The key: a word like another") == []
    assert [n for n, _, _ in pairs("x := 5\ny = x # z")] == ["x", "y"]


def test_redaction_and_odd_rows(spark):
    rows = [(1, "token=abcdefgh12 and more", None, None, 0), (2, None, None, None, 0), (None, "", None, None, 0), (1, "token=abcdefgh12 and more", None, None, 0)]
    got = redact_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text or "" for r in got) == ["", "", "[secret] and more", "[secret] and more"]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as spans", "2 as n_hex")
    assert sorted(r.n_assign for r in find_secrets(clash).collect()) == [0, 0, 1, 1]
    assert find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spans_of("x" * 2_000_000) == [] and len(spans_of("a=" * 100_000)) == 0


def test_literals_and_names_of_any_length():
    long = "".join(random.Random(1).choices("abcdefghijkABCDEFGHIJK0123456789", k=10_000))
    for text in (f'private_key = "{long}"', f"private_key = '{long}'", f"private_key = {long} ;"):
        assert found(text) == [long]
    name = "x" * 500 + "." + "y" * 500 + ".auth_private_key"
    assert found(f'{name}{" " * 300}={" " * 300}"{long}"') == [long]


def test_declared_types():
    for text in (
        'auth_private_key: str = "Xk29sLq8Zp4v"', 'val privateAuthKey: String = "Xk29sLq8Zp4v"', 'let auth_private_key: &str = "Xk29sLq8Zp4v";', 'var privateAuthKey string = "Xk29sLq8Zp4v"',
        'auth_private_key: Optional[str] = "Xk29sLq8Zp4v"', 'const char *auth_private_key = "Xk29sLq8Zp4v"', 'run: auth_private_key="Xk29sLq8Zp4v"', 'conf["auth_private_key"] = b"Xk29sLq8Zp4v"',
    ):
        assert found(text) == ["Xk29sLq8Zp4v"], text


def test_constants_that_grow_and_large_texts():
    import time

    text = 'x = "Zx81kQpT77vbNw02"\n' + "x = x + x\n" * 60 + "auth_private_key = x + x"
    assert found(text) == ["Zx81kQpT77vbNw02"]
    assert len(pairs(text)) == 62
    began = time.time()
    lines = [f'service_auth_key_{i} = "Zx81kQpT77vb{i:05}"' for i in range(20_000)]
    assert len(found("\n".join(lines))) == 20_000
    for odd in ("secret_key=" * 90_000, "a:b=" * 250_000, "x='\"=" * 200_000, ":a[" * 300_000, "=\"\\" * 300_000, "key: " + "a.b-" * 250_000 + "= z", "x = x + " * 120_000):
        spans_of(odd)
    assert time.time() - began < 60


def test_literals_that_overlap_plain_findings():
    text = 'password = "Zq9Abcdef$mK2%XyT7pLr8Wn3QvB5"'
    assert found(text) == ["Zq9Abcdef$mK2%XyT7pLr8Wn3QvB5"]
    assert [k for _, k, _ in spans_of(text)] == [0, 3]
    inner = "Zq9mK2g" + "0123456789abcdef" * 2 + "gXyT7pLr8Wn3QvB5"
    assert found(f'private_key = "{inner}"') == [inner]


def test_whole_literals_are_scored():
    tail = "".join(random.Random(3).choices("abcdefghABCDEFGH0123456789", k=44))
    for n in (200, 256, 5000):
        assert found(f'private_key = "{"x" * n}{tail}"') == ["x" * n + tail]
    assert found(f'auth_private_key = "{"x" * 5000}"') == []


def test_words_inside_words_are_scored_whole():
    middle = "".join(random.Random(3).choices("abcdefghABCDEFGH0123456789", k=600))
    for n in (256, 300, 3000):
        value = "x" * n + "/" + middle + "x" * n
        assert found(f"colour=private_key={value}") == [value]
    # every end's value is that of its characters
    text = "".join(random.Random(4).choices(["key=", "b:", "Zx81k", "é", "xx", "-"], k=4_000))
    nested = [(x, p) for x in assignments(text) for p in x.parts if len(p) == 3]
    assert len(nested) > 1_000
    for x, p in nested[::50]:
        got, want = valued(text, x), Value(text[p[0] : p[1]])
        assert (got.head, got.size, got.blanks, got.counts) == (want.head, want.size, want.blanks, want.counts)


def test_other_syntax():
    value = "Xk29sLq8Zp4vWm71"
    for text in (
        f'auth_private_key = """{value}"""', f"auth_private_key = '''{value}'''", f"const authPrivateKey = `{value}`", f"auth_private_key: |\n  {value}\nnext: 1", f"a:\n  auth_private_key: >-\n    {value}\n\n  b: 2",
        f"<authPrivateKey>{value}</authPrivateKey>", f'<entry name="auth_private_key"> {value} </entry>', f'db.set_password("{value}")', f"client.withAuthPrivateKey('{value}')", f'props.put("auth_private_key", "{value}")',
        f'AUTH_PRIVATE_KEY = raw\nraw = "{value}"', f'AUTH_PRIVATE_KEY = a\na = b\nb = "{value}"',
    ):
        assert found(text) == [value], text
    lines = ["MIIEvQIBADANBgkqhkiG9w0BAQE", "FAASCBKcwggSjAgEAAoIBAQC7"]
    assert found("private_auth_key: |\n" + "".join(f"    {x}\n" for x in lines) + "other: 1\n") == lines
    for text in ('print("Xk29sLq8Zp4vWm71")', "<p>Xk29sLq8Zp4vWm71</p>", "auth_private_key = a\na = auth_private_key", "colour: |\n  Xk29sLq8Zp4vWm71\n", 'x = """Xk29sLq8Zp4vWm71"""'):
        assert found(text) == [], text


def test_redaction_leaves_no_part(spark):
    texts = ['password = "Zq9Abcdef$mK2%XyT7pLr8Wn3QvB5" # end', 'private_key = "Zq9mK2g' + "ab12cd34" * 4 + 'gXyT7pLr8Wn3QvB5"', "auth_private_key: |\n  MIIEvQIBADANBgkqhkiG9w0BAQE\n  FAASCBKcwggSjAgEAAoIBAQC7\nb: 1"]
    got = [r.text for r in redact_secrets(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()]
    assert got == ['[secret]" # end', 'private_key = "[secret]"', "auth_private_key: |\n  [secret]\n  [secret]\nb: 1"]


def test_other_syntax_takes_time_in_proportion():
    import time

    began = time.time()
    for odd in ('a="""' * 100_000, "a='''" * 100_000, "a=`" * 200_000, "k: |\n" * 100_000, "<a>x" * 200_000, 'set_a("' * 100_000, '("a","' * 100_000, "b = c\n" * 100_000, "a: |\n" + "  b c\n" * 200_000, "<a " * 200_000, "x = y\ny = x\n" * 60_000):
        spans_of(odd)
    assert time.time() - began < 60
