"""Translation services behind the backend protocol: chat over HTTP on this network, the same at a host with a key, and a client library.

Every row is one request, sent from the tasks that hold the rows (``mapInPandas``). A request that fails gives an empty
reply and is tried again by the retry rounds; a task that Spark runs twice asks twice.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import translate

# What the services are told to do, and the seconds they may take (fixed value).
KEEP = "Leave English words, figures, units, addresses and part numbers as they are."
PARAGRAPH_PROMPT = f"You translate Japanese into Simplified Chinese. The input is one paragraph: answer with its translation alone, as one paragraph, without remarks. {KEEP}"
JSON_PROMPT = (
    "You translate Japanese into Simplified Chinese. The input is a JSON object with an array \"items\" of objects with \"id\" and \"text\". Answer with a JSON object of the same form: "
    f"every id once, text translated, no item left out, merged or split, no remarks. {KEEP}"
)
TIMEOUT = 1800

Ask = Callable[[str, str, bool], str]


def post(url: str, payload: dict, headers: dict[str, str], timeout: int = TIMEOUT) -> dict:
    request = urllib.request.Request(url, json.dumps(payload, ensure_ascii=False).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310  the address is an option of the run
        return json.loads(reply.read())


class Service:
    """A backend that sends each request by ``ask(system, user, as_json)``, built once in each task by ``connect``."""

    def connect(self) -> Ask:
        raise NotImplementedError

    def _replies(self, rows: DataFrame, key: str, text: str, system: str, as_json: bool) -> DataFrame:
        connect = self.connect

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = connect()
            for batch in batches:
                out = []
                for x in batch[text]:
                    try:
                        out.append(ask(system, x, as_json).strip())
                    except Exception:  # noqa: BLE001  a failed request must not lose the others
                        out.append("")
                yield pd.DataFrame({key: batch[key], "reply": out})

        return rows.select(*dict.fromkeys([key, text])).mapInPandas(run, f"{key} string, reply string")

    def translate_json(self, requests: DataFrame) -> DataFrame:
        return self._replies(requests, "chunk_id", "request", JSON_PROMPT, True)

    def translate_text(self, texts: DataFrame) -> DataFrame:
        return self._replies(texts, "source_text", "source_text", PARAGRAPH_PROMPT, False)


def _messages(system: str, user: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": user}]


class LocalService(Service):
    """A chat server of one's own; its reply is ``message.content``."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "qwen3:8b", timeout: int = TIMEOUT):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def connect(self) -> Ask:
        url, model, timeout = self.url, self.model, self.timeout

        def ask(system: str, user: str, as_json: bool) -> str:
            payload = {"model": model, "messages": _messages(system, user), "stream": False, "think": False, "options": {"temperature": 0 if as_json else 0.1, "num_gpu": 100}}
            return post(f"{url}/api/chat", payload | ({"format": "json"} if as_json else {}), {}, timeout)["message"]["content"]

        return ask


class HostedService(Service):
    """A hosted chat service with a key; its reply is ``choices[0].message.content``."""

    def __init__(self, url: str, key: str, model: str = "openai/gpt-4o-mini", timeout: int = TIMEOUT):
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def connect(self) -> Ask:
        url, key, model, timeout = self.url, self.key, self.model, self.timeout

        def ask(system: str, user: str, as_json: bool) -> str:
            payload = {"model": model, "messages": _messages(system, user), "temperature": 0 if as_json else 0.1}
            payload |= {"response_format": {"type": "json_object"}} if as_json else {}
            return post(f"{url}/chat/completions", payload, {"Authorization": f"Bearer {key}"}, timeout)["choices"][0]["message"]["content"]

        return ask


class ClientService(Service):
    """A service reached through a client library: ``start()`` gives the asking function, once in each task."""

    def __init__(self, start: Callable[[], Ask]):
        self.connect = start


translate.register_backend("local", LocalService)
translate.register_backend("hosted", HostedService)
translate.register_backend("client", ClientService)
