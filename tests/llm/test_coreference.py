"""One entity, one surrogate, however and wherever it is written."""

import re

from seqloom.llm import surrogates as s

MAPS = s.Surrogates(b"k1")


def digits(x):
    return re.sub(r"\D", "", x)


def test_formats_of_one_entity_agree():
    phones = ["+1 (446) 555-8962", "+1-446-555-8962", "+1 446 555 8962", "+14465558962", "(446) 555-8962", "446-555-8962"]
    assert len({digits(MAPS.of("phone", x))[-10:] for x in phones}) == 1
    assert all(re.sub(r"\d", "0", MAPS.of("phone", x)) == re.sub(r"\d", "0", x) for x in phones)
    assert digits(MAPS.of("phone", "+44 20 7946 0958")) == digits(MAPS.of("phone", "+44 (0)20 7946 0958").replace("(0)", ""))
    assert MAPS.of("phone", "+٤٤ ٢٠ ٧٩٤٦")  # digits of other scripts stay
    assert MAPS.of("email", "John@x.com").lower() == MAPS.of("email", "john@x.com") != "john@x.com"
    key = "ghp_" + "a1B2" * 9
    assert MAPS.of("assigned", f'token = "{key}').endswith(MAPS.of("secret", key))


def test_bare_mentions():
    out, found = MAPS.replace("Smith wrote. Mrs. Smith and Anna Jones met. Anna left, Smith's car stayed; SMITHSON, Blacksmith did not. Jones!")
    assert not re.search(r"\b(?:Smith|Anna|Jones)\b", out) and "SMITHSON, Blacksmith did not" in out
    name = {w: MAPS.of("person", w) for w in ("Smith", "Anna", "Jones")}
    assert out == f"{name['Smith']} wrote. Mrs. {name['Smith']} and {name['Anna']} {name['Jones']} met. {name['Anna']} left, {name['Smith']}'s car stayed; SMITHSON, Blacksmith did not. {name['Jones']}!"
    assert [e["start"] for e in found] == sorted(e["start"] for e in found) and len(found) == 6
    assert MAPS.of("person", "Mr. SMITH") == "Mr. " + name["Smith"].upper()
    assert MAPS.of("person", "Mrs. Anna").split()[1] == MAPS.of("person", "Anna Smith").split()[0]
