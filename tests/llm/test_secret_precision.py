"""Operator 2's judgement: random strings of many alphabets are reported, ordinary identifiers, paths and words are not."""

import random

import pytest

from daybook.llm import secret_scan

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (DIGIT + "abcdef", DIGIT + "ABCDEF", UPPER + "234567", LOWER + DIGIT, UPPER + LOWER + DIGIT, UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_", LOWER, UPPER, UPPER + LOWER)
WORDS = (
    "acknowledge adapter aggregate archive balance barrier bookmark boundary browser builder cascade catalog checkout cluster commerce compiler condition consumer coordinate dashboard decorator delegate dispatch dynamic element "
    "endpoint envelope exception executor fixture fragment framework gateway geometry graphics hierarchy histogram identity increment inspector interface invoice journal kernel knowledge landscape lifecycle literal manifest metadata "
    "migration namespace notification observer orchestrator outbound override pagination partition payload pipeline predicate processor quantity reconcile recovery registry renderer retention rollback scenario scheduler segment sequence "
    "shipment snapshot strategy subscriber synchronize telemetry template threshold timeline topology transaction translator upload validator vendor warehouse workflow workspace"
).split()
PLAIN = (
    "validate_session_middleware", "RefreshTokenRepositoryImpl", "src/handlers/oauth/callback.py", "//example.com/docs/guide", "application/x-www-form-urlencoded", "getAuthorizationHeader", "AbstractCredentialsProviderFactory",
    "DEFAULT_REQUEST_TIMEOUT_MS", "internationalization", "org.example.security.web", "test_login_rejects_expired", "node_modules/express", "version-2024-snapshot", "docs/architecture.md", "HttpServletRequest", "XMLHttpRequestUpload", "utf8_general_collation",
)


def reported(novelty, token):
    text = f"The auth check calls {token} before the request goes on."
    base = secret_scan.base_spans(text)
    return [text[a:b] for a, b, _ in base + secret_scan.novel_spans(text, base, novelty)]


@pytest.mark.parametrize("primed", [b"", b"request\nbefore\ncheck\nsession\n"])
def test_recall_and_precision(primed):
    rng, novelty = random.Random(2), secret_scan.Novelty(primed)
    secrets = ["".join(rng.choice(a) for _ in range(rng.choice([16, 20, 24, 32, 40, 64]))) for a in ALPHABETS for _ in range(40)]
    found = sum(any(s in x or len(x) > 8 and x in s for x in reported(novelty, s)) for s in secrets)
    harmless = list(PLAIN)
    while len(harmless) < 400:
        w = [rng.choice(WORDS) for _ in range(rng.randrange(2, 5))]
        made = ("_".join(w), "".join(x.title() for x in w), w[0] + "".join(x.title() for x in w[1:]), "src/" + "/".join(w) + ".py", "-".join(w), ".".join(["com", *w]), "_".join(w).upper() + rng.choice(["", "_2", "_V1", "_2024"]))
        harmless += [x for x in [rng.choice(made)] if len(x) >= secret_scan.SHORTEST]
    false = [x for x in harmless if reported(novelty, x)]
    assert found >= 0.9 * len(secrets), found / len(secrets)
    assert not false
