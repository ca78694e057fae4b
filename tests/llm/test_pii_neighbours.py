"""Personal numbers beside other digits, and phone numbers whose format alone makes them certain."""

from vitalgrid.llm.pii import pseudonymise

CARD = "4111 1111 1111 1111"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonymise(df, "k1").collect()}
    return [got[i] for i in range(len(texts))]


def test_phones_of_certain_format(spark):
    certain = ["+1 (017) 555-7713", "(017) 555-7713", "+1 415 055-7713", "+1-015-155-7713", "1-415-155-7713",
               "+1 (115) 555-1234"]
    bare = ["017-555-7713", "415 055 7713"]
    many = [f"+1 ({b}{a:02d}) 155-{n:04d}" for b in (0, 1) for a in range(3) for n in range(20)]
    got = run(spark, [f"call {x}, or" for x in certain + bare + many])
    for old, r in zip(certain, got, strict=False):
        assert (r["n_replaced"], r["kinds"]) == (1, "phone") and old not in r["text"] and len(r["text"]) == len(old) + 9
    assert got[0]["text"][8:] == got[1]["text"][5:] and got[0]["text"][9] in "01"
    assert [r["text"] for r in got[len(certain):][:len(bare)]] == [f"call {x}, or" for x in bare]
    assert len({r["text"] for r in got[-len(many):]}) == len(many)


def test_cards_and_phones_beside_other_digits(spark):
    alone, phone = run(spark, [CARD, "555-223-4567"])
    new, solid = alone["text"], alone["text"].replace(" ", "")
    assert luhn(solid) and new != CARD
    cases = [f"{CARD} 123", f"{CARD} 12/25", f"12 {CARD}", f"123 {CARD} 7", f"12345 {CARD}", f"{CARD} {CARD}",
             f"{CARD} 12a", f"9 8 7 {CARD} 6 5 4"]
    cases += [c.replace(CARD, "4111111111111111") for c in cases] + [c.replace(CARD, CARD.replace(" ", "-")) for c in cases]
    got = run(spark, cases)
    for case, r in zip(cases, got, strict=True):
        want = case.replace(CARD, new).replace("4111111111111111", solid).replace(CARD.replace(" ", "-"), new.replace(" ", "-"))
        assert r["text"] == want and set(r["kinds"].split(",")) == {"card"} and r["n_replaced"] == case.count("4111"), case
    other = ["123 555-223-4567", f"{CARD} 555-223-4567", f"{CARD} 555.223.4567", f"{CARD} 10.1.2.3 x", f"{CARD} 1999-12-31"]
    got = run(spark, other)
    assert got[0]["text"] == "123 " + phone["text"] and got[1]["text"] == f"{new} {phone['text']}"
    assert [r["kinds"] for r in got] == ["phone", "card,phone", "card,phone", "card,ip", "card,date"]
    assert all(r["text"].startswith(new) for r in got[1:])


def test_what_is_no_card_stays(spark):
    texts = ["4111 1111 1111 1112", "4" * 25, "1 2 3", "x4111111111111111", "", "1234567890123-4", "7" * 5000 + " 1"]
    assert [(r["text"], r["n_replaced"]) for r in run(spark, texts)] == [(t, 0) for t in texts]


def mod97(iban):
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def test_ibans(spark):
    base = "GB82WEST12345698765432"
    cases = [base, "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    got = run(spark, [f"to {c}, now" for c in cases])
    for old, r in zip(cases, got, strict=True):
        new = r["text"][3:-5]
        assert r["kinds"] == "iban" and len(new) == len(old) and new != old and mod97(new.replace(" ", "")) == 1
        assert [c.isdigit() for c in new] == [c.isdigit() for c in old] and new[:2] == old[:2]
    assert got[0]["text"] == got[1]["text"].replace(" ", "").replace("to", "to ").replace(",now", ", now")
    bad = ["GB83WEST12345698765432", "DE89370400440532013001", "AB12CDEF", "GB82WEST12345698765432X" * 3]
    assert [r["n_replaced"] for r in run(spark, bad)] == [0] * len(bad)


def test_dates_of_many_layouts_share_a_day(spark):
    import datetime
    texts = ["1999-12-31", "31/12/1999", "31.12.1999", "12/31/1999", "Dec 31, 1999", "31 December 1999", "December 31, 1999"]
    got = [r["text"] for r in run(spark, [f"on {t}; or" for t in texts])]
    days = [datetime.datetime.strptime(g[3:-4], f).date() for g, f in zip(got, [
        "%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y", "%b %d, %Y", "%d %B %Y", "%B %d, %Y"], strict=True)]
    assert len(set(days)) == 1 and days[0] != datetime.date(1999, 12, 31)
    start = datetime.date(2019, 11, 20)
    many = [(start + datetime.timedelta(days=i)) for i in range(120)]
    new = [r["text"] for r in run(spark, [f"{d.day}/{d.month}/{d.year}" for d in many])]
    assert len({datetime.datetime.strptime(x, "%d/%m/%Y") for x in new}) == len(many)
    stay = ["31/13/1999", "30/2/2020", "Feb 30, 2020", "1/2/99", "3.14.1592.6", "Mayor 5, 2020", "32 May 2020", "1/2/2020/3"]
    assert [r["text"] for r in run(spark, stay)] == stay
