"""The markup reader against one that goes character by character."""

import random

from loomwork.sources import archives

SPACE = " \t\n\r"


def read(t):
    """(kind, name, value, attributes) of each event."""
    out, i = [], 0

    def upto(mark, i):
        j = t.find(mark, i)
        return (t[i:], len(t)) if j < 0 else (t[i:j], j + len(mark))

    def word(i):
        j = i
        while j < len(t) and t[j] not in SPACE + ">/=":
            j += 1
        return t[i:j], j

    def blanks(i):
        while i < len(t) and t[i] in SPACE:
            i += 1
        return i

    while i < len(t):
        if t.startswith("<!--", i):
            value, i = upto("-->", i + 4)
            out.append(("comment", None, value, None))
        elif t.startswith("<!-", i):
            break
        elif t.startswith("<![CDATA[", i):
            value, i = upto("]]>", i + 9)
            out.append(("cdata", None, value, None))
        elif t.startswith("<?", i):
            inner, i = upto("?>", i + 2)
            name = inner
            for stop in SPACE + ">/=":
                name = name.split(stop)[0]
            out.append(("instruction", name.removesuffix("?"), None, None))
        elif t.startswith("<!", i):
            _, i = upto(">", i)
        elif t.startswith("</", i):
            name, _ = word(i + 2)
            out.append(("end", name, None, None))
            _, i = upto(">", i)
        elif t[i] == "<":
            name, i = word(i + 1)
            attrs = {}
            while True:
                j = blanks(i)
                key, j = word(j)
                j = blanks(j)
                if not key or t[j : j + 1] != "=":
                    break
                j = blanks(j + 1)
                if t[j : j + 1] not in ('"', "'") or j >= len(t):
                    break
                value, i = upto(t[j], j + 1)
                attrs.setdefault(key, value)
            out.append(("element", name, None, attrs))
            if t[blanks(i) : blanks(i) + 1] == "/":
                out.append(("end", name, None, None))
            _, i = upto(">", i)
        else:
            j = t.find("<", i)
            j = len(t) if j < 0 else j
            if t[i:j].strip(SPACE):
                out.append(("text", None, t[i:j].strip(" "), None))
            i = j
    return out


def test_events_equal_a_reader(spark):
    rng = random.Random(3)
    bits = ["<!--", "-->", "<![CDATA[", "]]>", "<?x ", "?>", "<!DOCTYPE d>", "</a>", "<a", ' k="1"', " z=2", " y='3>'", ' k="4"', "/>", ">", "text", " ", "\n", "<b>", "é", "]", "-", "=", '"', "<br/>"]
    docs = {i: "".join(rng.choice(bits) for _ in range(rng.randrange(1, 18))) for i in range(1500)}
    docs |= {9000: "", 9001: "<!-x>never", 9002: "a<!-- b", 9003: "<![CDATA[a > b]]>", 9004: '<e k="1" z=2 y="3">t</e>', 9005: "x" * 100_000 + "<!--" + "-" * 50_000}
    df = spark.createDataFrame([*docs.items(), (9999, None)], "id long, t string")
    got = {}
    for r in archives.xml_events(df, "id", "t").orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.kind, r.name, r.value, r.attrs))
    for i, t in docs.items():
        assert got.get(i, []) == read(t), t
    assert got[9003] == [("cdata", None, "a > b", None)] and got[9004][0] == ("element", "e", None, {"k": "1"})
    assert 9999 not in got
