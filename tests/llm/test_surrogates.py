"""Addresses and domains of mail keep distinct, whatever their number, and one thing keeps one surrogate."""

import ipaddress
from itertools import product
from string import ascii_lowercase

import pytest

from argusframe.llm import privacy

KEY = b"secret"


def test_spellings_of_one_address(spark):
    texts = ["at fe80::1 now", "at FE80::0001 now", "at fe80:0:0:0:0:0:0:1 now", "at fe80::2 now", "from ::1.", "from ::ffff:a:1 too", "net 2001:db8:: here"]
    got = {r.id: r.text for r in privacy.surrogated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    same = {str(ipaddress.IPv6Address(got[i].split()[1])) for i in range(3)}
    assert len(same) == 1 and same != {"fe80::1"} and same.pop().startswith("fe80:")
    assert got[1].split()[1].isupper() or got[1].split()[1].replace(":", "").isdigit()
    assert all(got[i] != texts[i] for i in range(7)) and got[3].split()[1] != got[0].split()[1]


@pytest.mark.parametrize("text", ["x[::2]", "std::move", "12:30:45", "a::b::c", "1:2:3", "fe80::1::2", "::", "g::1"])
def test_what_is_no_address(text):
    assert privacy.entities(text) == []


def test_full_blocks_end(spark):
    """60,000 addresses of one block of 65,536, each with a surrogate of its own."""
    rows = [("ip6", str(ipaddress.IPv6Address((0xFE80 << 112) + i)), "u") for i in range(60_000)]
    got = privacy.surrogates(spark.createDataFrame(rows, "kind string, value string, gender string"), KEY).collect()
    assert len({r.made for r in got}) == 60_000 == len(got)
    assert all(r.made.startswith("fe80:") for r in got)


def test_all_short_domains_are_distinct(spark):
    """The 676 domains of two letters, with two mailboxes each: as many domains, and mail of one domain stays together."""
    rows = [("email", f"{box}@{a}{b}.com", "u") for a, b in product(ascii_lowercase, repeat=2) for box in ("info", "x1")]
    got = {r.value: r.made for r in privacy.surrogates(spark.createDataFrame(rows, "kind string, value string, gender string"), KEY).collect()}
    assert len(set(got.values())) == len(rows) and not set(got.values()) & set(got)
    domain = {v.split("@")[1]: m.split("@")[1] for v, m in got.items()}
    assert len(set(domain.values())) == 676
    assert all(domain[v.split("@")[1]] == m.split("@")[1] for v, m in got.items())


@pytest.mark.parametrize("text", ["", "a", "Ab-9.z", "é0", "x" * 300])
def test_texts_are_permuted_in_their_format(text):
    made = privacy.permuted_text(KEY, "t", text)
    assert len(made) == len(text) and [c.isdigit() for c in made] == [c.isdigit() for c in text] and [c.isupper() for c in made] == [c.isupper() for c in text]
    if text == "a":
        assert {privacy.permuted_text(KEY, "t", c) for c in ascii_lowercase} == set(ascii_lowercase)
