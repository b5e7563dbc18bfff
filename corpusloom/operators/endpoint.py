"""A provider that asks a chat-completions endpoint over HTTP."""

from __future__ import annotations

import json

from corpusloom.operators.generate import Provider

# Seconds and tokens of one call.
SECONDS, MOST_TOKENS = 120, 2048


def chat(url: str, model: str, key: str = "none", seconds: float = SECONDS, tokens: int = MOST_TOKENS) -> Provider:
    """A provider for url (the part before /chat/completions); an HTTP error, a time-out or an answer without text raises."""

    def provider(system: str, message: str, temperature: float) -> str:
        import urllib.request  # here, as a worker that calls chat itself would not have it

        turns = [{"role": "system", "content": system}, {"role": "user", "content": message}]
        body = json.dumps({"model": model, "messages": turns, "temperature": temperature, "max_tokens": tokens}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        with urllib.request.urlopen(urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, head), timeout=seconds) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    return provider
