"""Forms of declarations, literals and constants that the secret scan follows."""

import pytest

from voxledger.llm import secret_scan

VALUE = "Zx9$kLm2!pQr"
FORMS = {
    "python": f'api_secret: str = "{VALUE}"',
    "python union": f'db_password: Optional[str] | None = "{VALUE}"',
    "typescript": f"const apiSecret: string = '{VALUE}'",
    "go": f'var password string = "{VALUE}"',
    "rust": f"let secret: &'static str = \"{VALUE}\";",
    "c": f'static const char *password = "{VALUE}"',
    "triple": f'password = """{VALUE}"""',
    "triple single": f"password = '''\n{VALUE}\n'''",
    "lines": f"const password = `\n{VALUE}\n`",
    "next line": f'password = (\n    "{VALUE}"\n)',
    "prefix": f'password = b"{VALUE}"',
    "later constant": f'my_secret_key = BASE\nBASE = "{VALUE}"',
    "chain of later constants": f'my_secret_key = ONE\nONE = TWO\nTWO = "{VALUE}"',
    "attributes": f'<add key="db.password" value="{VALUE}" />',
    "setter": f'config.setPassword("{VALUE}");',
    "snake setter": f"config.set_api_key('{VALUE}')",
    "block in a block": f"data: |\n  private_key: |\n    {VALUE}\n  other: 1",
    "long name": f'password_{"of_the_service_" * 12}x = "{VALUE}"',
}


@pytest.mark.parametrize("form", FORMS)
def test_form(form):
    text = FORMS[form]
    assert VALUE not in secret_scan.redacted(text, secret_scan.lexed_spans(text))


def test_names_that_stand_for_each_other_end():
    assert secret_scan.lexed_spans("secret_a = secret_b\nsecret_b = secret_a\ntoken = token") is not None


def test_the_latest_constant_before_counts():
    text = f'A = "{VALUE}"\nA = "short"\nsecret_key = A'
    assert secret_scan.lexed_spans(text) == []


def lexed(text):
    return [text[s.start : s.end] for s in secret_scan.lexed_spans(text)]


def test_parts_blocks_elements_and_comparisons():
    assert lexed('secret_key = "Zx9$kLm2" + "!pQrT71"') == ['Zx9$kLm2" + "!pQrT71']
    assert lexed('if DB == x:\n  DB = "Zx9$kLm2!pQr71"\nmy_secret = DB') == ["Zx9$kLm2!pQr71"]
    assert lexed("<password>Zx9$kLm2!pQr</password>") == ["Zx9$kLm2!pQr"]
    assert lexed("api_secret: |\n  Zx9$kLm2!pQr\n  aB3$\nother: 1") == ["Zx9$kLm2!pQr\n  aB3$"]
    assert lexed("url = http://h?db_password=Zx9$kLm2!pQr&x=1") == ["Zx9$kLm2!pQr"]


def test_time_is_linear_in_a_long_text():
    import time

    for unit in ("a=b&", "a=a=", "a::a", 'a="a=', " a: |\n", '<a key="b"', "setA("):
        began = time.perf_counter()
        secret_scan.all_spans(unit * 50_000)
        assert time.perf_counter() - began < 30
