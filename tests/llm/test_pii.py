import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii, queries
from millrace.llm.pii import BASE_KINDS, find_pii, luhn, redact, spans_of
from tests.llm.conftest import HARD, assert_linear


def plain(text):
    """The base kinds by plain search over the text."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base(text):
    return [s for s in spans_of(text) if s[0] in BASE_KINDS]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123459_%é😀\n:/"), max_size=60))
def test_base_spans_equal_plain_search(text):
    assert base(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4952935900253052", "4952-9359 0025 3052", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b.c@d.e", "+1 (017) 555-7713", "+", "@", " ", ".", "x", "-", "é", "001.02.3.255"]), max_size=12))
def test_base_spans_equal_plain_search_on_near_forms(parts):
    assert base("".join(parts)) == plain("".join(parts))


@pytest.mark.parametrize("part", ["1", "1.", "1 ", "a", "a@", "@", "+1", "+1 (", ":", "1:", "account ", "12 Elm ", "Rue de ", "http://", "iban GB82 "])
def test_time_grows_with_the_text(part):
    assert_linear(spans_of, part)


def test_more_kinds():
    text = "See https://example.org/a?b=1. Lives at 12 Elm Street, IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678, SSN 123-45-6789, host 2001:db8::1 up"
    assert {text[a:b] for k, a, b in spans_of(text) if k not in BASE_KINDS} == {"https://example.org/a?b=1", "12 Elm Street", "GB82 WEST 1234 5698 7654 32", "12345678", "123-45-6789", "2001:db8::1"}
    assert not [s for s in spans_of("IBAN: GB82 WEST 1234 5698 7654 33 and std::vector a::b") if s[0] in ("iban", "ipv6")]


def test_cues_in_any_case_and_full_ipv6():
    text = "His Social Security Number 123-45-6789, soCial seCurity 123-45-6780; İ host 2001:0db8:85a3:0000:0000:8a2e:0370:7334, or Fe80:0:0:0:1:2:3:4."
    assert [(k, text[a:b]) for k, a, b in spans_of(text) if k not in BASE_KINDS] == [("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ipv6", "Fe80:0:0:0:1:2:3:4"), ("ssn", "123-45-6789"), ("ssn", "123-45-6780")]
    assert redact("Social Security 123-45-6789 at 1:2:3:4:5:6:7:8") == "Social Security [ssn] at [ipv6]"
    assert not [s for s in spans_of("00:1a:2b:3c:4d:5e, 1:2:3:4:5:6:7:8:9, x1:2:3:4:5:6:7:8, 12:30:45, 12 elm street") if s[0] in ("ipv6", "street")]
    assert spans_of("1:" * 200_000) == []


def test_streets_of_four_languages():
    text = "At 12 Elm St., 7 Old Mill Road; 221B Baker Street, 5 rue de la Paix. 12 bis, avenue Victor Hugo; Calle Mayor 5, Plaza de España, 3; Lindenstraße 12a, Haupt-Straße 3, Am Alten Platz 9, Bahnhofstr. 4"
    found = [text[a:b] for k, a, b in spans_of(text) if k == "street"]
    assert found == ["12 Elm St.", "7 Old Mill Road", "221B Baker Street", "5 rue de la Paix", "12 bis, avenue Victor Hugo", "Calle Mayor 5", "Plaza de España, 3", "Lindenstraße 12a", "Haupt-Straße 3", "Am Alten Platz 9", "Bahnhofstr. 4"]
    for plain_text in ("the road 5", "in 12 streets", "He drove 12 Long Roadsters", "3 rue", "Calle", "der weg 5", "on the way 12 Drive", "boring 5", "a ring 12"):
        assert not [s for s in spans_of(plain_text) if s[0] == "street"], plain_text


def test_account_numbers_are_validated():
    text = "SSN 000-12-3456, SSN 666-12-3456, SSN 900-12-3456, SSN 123-00-3456, SSN 123-45-0000, account 000000, account 111 111 11, acct 12 34 56 78"
    assert [(k, text[a:b]) for k, a, b in spans_of(text) if k in ("ssn", "account")] == [("account", "12 34 56 78")]


def test_redaction():
    assert redact("to joe@site.org or +1 (017) 555-7713") == "to [email] or [phone]"


def test_hard_rows(docs):
    rows = [(None, "a@b.co"), (7, "a@b.co"), (7, "a@b.co"), *((100 + k, x) for k, x in enumerate(HARD))]
    found = find_pii(docs(*rows, clashing=True)).collect()
    assert len(found) == len(rows)
    assert [len(r.spans) for r in found if r.doc_id in (None, 7)] == [1, 1, 1]
    assert all(not r.spans for r in found if r.doc_id in (100, 101, 102))
    assert find_pii(docs("x").limit(0)).collect() == []


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))
