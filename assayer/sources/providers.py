"""Chat models as plug-ins: batches in, texts out; keys stay out of the plan until a worker needs them."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, replace

from ..operators.answering import Extractive

#: What is told of a failed request; never the server's own words.
STATUS = {400: "the request was not understood", 401: "the key was refused", 403: "access was refused", 404: "the model is not known", 413: "the request is too large", 429: "the rate limit is reached"}


class ProviderError(RuntimeError):
    """A model call failed; the text is safe to show."""


def error_text(status: int | None) -> str:
    if status is None:
        return "the service can't be reached"
    return STATUS.get(status, "the service failed" if status >= 500 else "the request was refused")


@dataclass(frozen=True)
class HttpChat:
    """A chat service with an OpenAI-like (kind 'groq') or an Ollama API. The key is read from the environment variable
    key_env on the worker."""

    name: str
    model: str
    url: str
    key_env: str = ""
    timeout: int = 60
    temperature: float = 0.0

    def request(self, system: str, user: str) -> urllib.request.Request:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False}
        body |= {"options": {"temperature": self.temperature}} if self.name == "ollama" else {"temperature": self.temperature}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ.get(self.key_env, '')}"} if self.key_env else {})
        return urllib.request.Request(self.url, json.dumps(body).encode(), headers)

    def counted(self, system: str, user: str) -> tuple[str, int, int]:
        """The text, and the prompt and completion tokens that the service counted."""
        try:
            with urllib.request.urlopen(self.request(system, user), timeout=self.timeout) as r:
                found = json.load(r)
        except urllib.error.HTTPError as e:
            raise ProviderError(error_text(e.code)) from None
        except (OSError, ValueError):
            raise ProviderError(error_text(None)) from None
        if self.name == "ollama":
            return found["message"]["content"], found.get("prompt_eval_count", 0), found.get("eval_count", 0)
        used = found.get("usage", {})
        return found["choices"][0]["message"]["content"], used.get("prompt_tokens", 0), used.get("completion_tokens", 0)

    def complete(self, prompts: list[tuple[str, str]]) -> list[str | None]:
        out: list[str | None] = []
        for system, user in prompts:
            try:
                out.append(self.counted(system, user)[0])
            except (ProviderError, KeyError, IndexError, TypeError):
                out.append(None)
        return out


def build_provider(config):
    if config.provider == "groq":
        return HttpChat("groq", config.model or "llama-3.1-8b-instant", "https://api.groq.com/openai/v1/chat/completions", "GROQ_API_KEY", config.request_timeout_seconds)
    if config.provider == "ollama":
        return HttpChat("ollama", config.model or "llama3.2", os.environ.get("OLLAMA_URL", "http://localhost:11434") + "/api/chat", "", config.request_timeout_seconds)
    return Extractive()


def with_model(provider, model: str):
    """The same service and key with another model."""
    return replace(provider, model=model)


def judge(output: str | None) -> tuple[float | None, list[str], str]:
    """Score (0 to 1), unsupported claims (ten at most) and reasoning of a judging model's output."""
    text = output or ""
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
        score = min(1.0, max(0.0, float(found["score"])))
        return score, [str(x)[:300] for x in found.get("unsupported_claims", [])[:10]], str(found.get("reasoning", "without a reason"))[:1000]
    except (ValueError, KeyError, TypeError) as e:
        raise ProviderError("the judging model returned no valid JSON") from e
