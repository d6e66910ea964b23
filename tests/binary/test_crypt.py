import pytest
from foliospark.binary import crypt
from foliospark.binary.extract import extract
from foliospark.binary.syntax import PdfError
from foliospark.writer.pdf import Pdf


def test_published_vectors():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_cbc_encrypt(bytes(range(16)), bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt.aes_cbc_encrypt(bytes(range(32)), bytes(16), block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


@pytest.mark.parametrize("size", [16, 32])
def test_decryption_turns_encryption_round(size):
    data = bytes(range(256)) * 2
    key, iv = bytes(range(size)), bytes(range(16))
    assert crypt.aes_cbc_decrypt(key, iv, crypt.aes_cbc_encrypt(key, iv, data)) == data
    assert crypt.aes_cbc_decrypt(key, iv, b"") == b""


def made(**kw):
    return Pdf("a4", 50).set_info(title="Secret").text("Hidden words").export(**kw)


@pytest.mark.parametrize("cipher", ["rc4-40", "rc4", "aes128", "aes256"])
def test_files_by_user_and_owner(cipher):
    data = made(user_password="user", owner_password="owner", cipher=cipher)
    assert b"Hidden" not in data and b"Secret" not in data
    for password in ("user", "owner"):
        got = extract(data, password=password, recover=False)
        assert got["docs"][0]["encrypted"] and got["runs"][0]["text"] == "Hidden words"
        assert got["meta"] == [{"key": "Title", "value": "Secret", "origin": "info"}]


def test_passwords_that_fail():
    data = made(user_password="user", cipher="aes128")
    for password, code in (("", "password_required"), ("no", "wrong_password")):
        with pytest.raises(PdfError) as e:
            extract(data, password=password, recover=False)
        assert e.value.code == code
        assert extract(data, {"docs"}, password=password)["docs"][0]["error"]["code"] == code


def test_the_empty_password_is_tried_first():
    assert extract(made(user_password="", owner_password="owner", cipher="rc4"), recover=False)["runs"][0]["text"] == "Hidden words"


def test_unknown_handlers():
    for d in ({"Filter": "Other"}, {"Filter": "Standard", "V": 3}, {"Filter": "Standard", "V": 5, "R": 5}):
        with pytest.raises(PdfError):
            crypt.Handler(d, b"")


def test_owner_password_takes_one_attempt(monkeypatch):
    data = Pdf().text("hidden").export(user_password="u", owner_password="o", cipher="aes128")
    keys = []
    fits = crypt.Handler._fits
    monkeypatch.setattr(crypt.Handler, "_fits", lambda self, key: keys.append(key) or fits(self, key))
    assert [r["text"] for r in extract(data, {"runs"}, password="o")["runs"]] == ["hidden"] and len(keys) == 1
    assert [r["text"] for r in extract(data, {"runs"}, password="u")["runs"]] == ["hidden"]
    assert extract(data, {"docs"}, password="x")["docs"][0]["error"]["code"] == "wrong_password"
