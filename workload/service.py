"""A stand-in for the translation service, failing by a rule over the text."""

from __future__ import annotations

import json

from segtrans.operators.backends import HttpBackend, HttpReply


class RuleTransport:
    """By text length modulo 5: 0 answers at once, 1 and 2 are throttled that
    many times first, 3 is never available, 4 is refused for good."""

    def __init__(self):
        self.tries: dict[str, int] = {}

    def __call__(self, url, payload, headers, timeout) -> HttpReply:
        text = payload["text"]
        rule = len(text) % 5
        if rule == 4:
            return HttpReply(200, json.dumps({"message_type": "ERROR", "message": "too hard"}))
        if rule == 3:
            return HttpReply(503, "")
        tried = self.tries.get(text, 0)
        if tried < rule:
            self.tries[text] = tried + 1
            return HttpReply(429, "")
        self.tries.pop(text, None)
        output = f"[{payload['tgt_lang']}] {text}"
        return HttpReply(200, json.dumps({"message_type": "SUCCESS", "output": output}))


def no_wait(seconds: float) -> None:
    pass


def rule_backend() -> HttpBackend:
    return HttpBackend(
        "https://translation.invalid/", name="rule", transport=RuleTransport(), sleep=no_wait,
        auth=dict,
    )
