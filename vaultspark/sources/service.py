"""A model service over HTTP, as an embedder and as a generator of answers. The engine takes any function in its place."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Sequence


class Service:
    """Paths and fields are fixed values of the service's interface. An answer that isn't a success raises."""

    def __init__(self, url: str, embedding_model: str, answer_model: str = "", timeout: float = 60.0) -> None:
        self.url, self.embedding_model, self.answer_model, self.timeout = url.rstrip("/"), embedding_model, answer_model, timeout

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._post("/api/embeddings", {"model": self.embedding_model, "prompt": t})["embedding"] for t in texts]

    def generate(self, prompts: Sequence[str]) -> list[str]:
        options = {"temperature": 0.1, "num_predict": 2048}
        return [self._post("/api/generate", {"model": self.answer_model, "prompt": p, "stream": False, "options": options})["response"] for p in prompts]

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=self.timeout) as answer:
                return 200 <= answer.status < 300
        except (urllib.error.URLError, OSError):
            return False
