import random

from seriesgrove.llm import secrets


def covered(text, key):
    """Whether a span of the method begins in the key and covers most of it."""
    at = text.index(key)
    return any(min(z, at + len(key)) - max(a, at) >= 20 for a, z, _ in secrets.Scanner().spans(text)[1])


def test_secrets_of_one_letter_case_are_found():
    rng = random.Random(9)
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(500)]
        assert sum(covered(f"see {k} here", k) for k in keys) >= 0.9 * len(keys)
    for clean in ("internationalization2024", "counterrevolutionaries", "TRANSCONTINENTALRAILWAY1869"):
        assert secrets.Scanner().spans(clean)[1] == [], clean


def test_a_placeholder_hides_no_key_that_is_joined_to_it():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzK9q2LdTs4v"
    for text in (f"example_{key}", f"{key}/placeholder", f"a-changeme={key}"):
        assert covered(text, key), text
    for clean in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ExamplePassword123ExamplePassword456"):
        assert secrets.Scanner().spans(clean)[1] == [], clean


def test_recall_of_planted_keys_by_class():
    """Random keys of common shapes between plain words: found by the method alone, without a keyword before them."""
    import random
    import string

    rng = random.Random(12)
    scan = secrets.Scanner()
    shapes = {
        "base64": (string.ascii_letters + string.digits + "+/", 40, 0.95), "mixed": (string.ascii_letters + string.digits, 36, 0.95), "lower": (string.ascii_lowercase + string.digits, 34, 0.9),
        "upper": (string.ascii_uppercase + string.digits, 32, 0.9), "hexupper": ("0123456789ABCDEF", 32, 0.9),
    }
    for name, (letters, n, least) in shapes.items():
        found = 0
        for _ in range(300):
            key = "".join(rng.choice(letters) for _ in range(n))
            text = f"we use {key} here, as told"
            found += any(a <= 7 + n // 4 and z >= 7 + n - n // 4 for a, z, _ in scan.spans(text)[1])
        assert found >= least * 300, (name, found)
    assert any(a <= 12 and z >= 40 for a, z, _ in scan.spans("key: ghp_16C7e42F292c6912E7710c838347Ae178B4a end")[1])
    words = ["international", "CamelCaseIdentifier", "/usr/local/share/applications", "some_snake_case_name_here", "UPPER_CASE_CONSTANT_NAME", "2024-01-02T03:04:05", "foo.bar.baz", "http://example.org/a/b/c"]
    assert all(not scan.spans(f"plain {w} text")[1] for w in words)
