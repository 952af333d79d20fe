"""Pluggable model clients, built inside Spark tasks from a plain options dict.

A client is chosen by ``opts["type"]`` from an explicit registry (the
reference looks classes up in ``globals()``).  Only plain dicts cross the
driver/executor boundary; each Python worker builds its client once and
keeps it for the worker's life.

Chat clients: ``batch(list[list[{"role", "content"}]]) -> list[str]`` and
``invoke(messages) -> str``.  Chain clients (LangServe-style) take JSON
payload strings.  Embedders: ``embed(list[str]) -> list[list[float]]``.

Network clients need a reachable endpoint; the ``md5-echo``, ``md5-json``,
``append-suffix`` and ``hashing`` types are deterministic local stand-ins
used by the tests and oracle queries, never presented as models.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from concurrent.futures import ThreadPoolExecutor

CHAT_CLIENTS: dict[str, type] = {}
EMBEDDERS: dict[str, type] = {}
_CACHE: dict[tuple[int, str], object] = {}


def chat_client(name):
    def deco(cls):
        CHAT_CLIENTS[name] = cls
        return cls
    return deco


def embedder(name):
    def deco(cls):
        EMBEDDERS[name] = cls
        return cls
    return deco


def _build(registry: dict, opts: dict):
    # A chat client and an embedder may have the same options: each registry has its own instances.
    key = id(registry), json.dumps(opts, sort_keys=True, default=str)
    if key not in _CACHE:
        o = dict(opts)
        kind = o.pop("type")
        if kind not in registry:
            raise ValueError(f"unknown client type {kind!r}; known: {sorted(registry)}")
        _CACHE[key] = registry[kind](**o)
    return _CACHE[key]


def make_chat_client(opts: dict):
    return _build(CHAT_CLIENTS, opts)


def make_embedder(opts: dict):
    return _build(EMBEDDERS, opts)


def transcript(messages) -> str:
    """``role: content`` lines; what the md5 stand-in hashes."""
    return "\n".join(f"{m['role']}: {m['content'] if m['content'] is not None else ''}" for m in messages)


class _ThreadedBatch:
    """``batch`` = ``invoke`` on a small thread pool (the library's .batch)."""

    concurrency = 1

    def batch(self, prompts):
        if self.concurrency <= 1 or len(prompts) <= 1:
            return [self.invoke(p) for p in prompts]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(self.invoke, prompts))


@chat_client("md5-echo")
class Md5EchoClient(_ThreadedBatch):
    """Answers ``md5(transcript)``.  ``fail_on``: a substring that makes a call fail."""

    def __init__(self, fail_on: str | None = None, concurrency: int = 1):
        self.fail_on = fail_on
        self.concurrency = concurrency

    def invoke(self, messages):
        t = transcript(messages)
        if self.fail_on and self.fail_on in t:
            raise RuntimeError(f"stub failure for input containing {self.fail_on!r}")
        return hashlib.md5(t.encode("utf-8")).hexdigest()


@chat_client("md5-json")
class Md5JsonChain:
    """Chain stand-in: answers ``md5(payload)`` for each JSON payload string."""

    def __init__(self, fail_on: str | None = None):
        self.fail_on = fail_on

    def invoke(self, payload):
        if self.fail_on and self.fail_on in payload:
            raise RuntimeError("stub chain failure")
        return hashlib.md5(payload.encode("utf-8")).hexdigest()

    def batch(self, payloads):
        return [self.invoke(p) for p in payloads]


@chat_client("append-suffix")
class AppendSuffixGenerator:
    """Prompt-generator stand-in for the optimisation loop.

    Reads the prompt out of the meta user message; answers it with
    ``suffix`` appended inside the prompt markers, or with the no-change
    marker when the prompt already ends with ``suffix``.
    """

    def __init__(self, suffix: str = " Be concise."):
        self.suffix = suffix

    def invoke(self, messages):
        user = messages[-1]["content"] or ""
        head = "* Prompt Template\n```\n"
        start = user.find(head)
        end = user.find("\n```\n* User Message")
        prompt = user[start + len(head):end] if start >= 0 and end >= 0 else user
        if prompt.endswith(self.suffix):
            return "<!-- NO CHANGE TO PROMPT -->"
        return f"<!-- BEGIN OF PROMPT -->\n{prompt}{self.suffix}\n<!-- END OF PROMPT -->"

    def batch(self, prompts):
        return [self.invoke(p) for p in prompts]


def _post_json(url: str, body: dict, headers: dict, timeout: float, retries: int):
    """POST with retries of what may pass later: no answer, 408, 429 and 5xx; other answers are final."""
    data = json.dumps(body).encode("utf-8")
    for attempt in range(retries + 1):
        try:
            req = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json", **headers})
            with urllib.request.urlopen(req, timeout=timeout) as r:
                return json.loads(r.read().decode("utf-8"))
        except Exception as e:  # noqa: BLE001 - retried, then re-raised
            final = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 429)
            if final or attempt == retries:
                raise
            time.sleep(min(2 ** attempt, 30))


@chat_client("openai")
class OpenAIChatClient(_ThreadedBatch):
    """OpenAI-compatible ``/chat/completions`` (also OpenRouter style gateways).

    ``temperature`` 0 is sent as given; options pass through unchanged.
    """

    ROLE = {"system": "system", "human": "user", "ai": "assistant", "user": "user", "assistant": "assistant"}

    def __init__(self, model: str, base_url: str = "https://api.openai.com/v1", api_key: str = "",
                 request_timeout: float = 600, max_retries: int = 3, concurrency: int = 4, **params):
        self.model, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key
        self.timeout, self.retries, self.concurrency, self.params = request_timeout, max_retries, concurrency, params

    def endpoint(self):
        return f"{self.base_url}/chat/completions", {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}

    def invoke(self, messages):
        body = {"model": self.model, "messages": [{"role": self.ROLE.get(m["role"], m["role"]),
                                                   "content": m["content"]} for m in messages], **self.params}
        url, headers = self.endpoint()
        out = _post_json(url, body, headers, self.timeout, self.retries)
        return out["choices"][0]["message"]["content"]


def _azure_url(base_url: str, deployment: str, action: str, api_version: str) -> str:
    quote = urllib.parse.quote
    return f"{base_url}/openai/deployments/{quote(deployment)}/{action}?api-version={quote(api_version)}"


@chat_client("azure-openai")
class AzureOpenAIChatClient(OpenAIChatClient):
    """Azure OpenAI chat: the deployment is part of the path, the key goes in an ``api-key`` header."""

    def __init__(self, deployment: str, base_url: str, api_version: str, api_key: str = "", model: str | None = None,
                 **params):
        super().__init__(model or deployment, base_url=base_url, api_key=api_key, **params)
        self.deployment, self.api_version = deployment, api_version

    def endpoint(self):
        return (_azure_url(self.base_url, self.deployment, "chat/completions", self.api_version),
                {"api-key": self.api_key})


@chat_client("langserve")
class LangServeClient:
    """Remote runnable: POST ``{url}/batch`` with ``{"inputs": [...]}``."""

    def __init__(self, url: str, request_timeout: float = 600, max_retries: int = 0):
        self.url, self.timeout, self.retries = url.rstrip("/"), request_timeout, max_retries

    def batch(self, payloads):
        body = {"inputs": [json.loads(p) for p in payloads]}
        out = _post_json(f"{self.url}/batch", body, {}, self.timeout, self.retries)
        return [o if isinstance(o, str) else json.dumps(o, ensure_ascii=False) for o in out["output"]]

    def invoke(self, payload):
        return self.batch([payload])[0]


@embedder("hashing")
class HashingEmbedder:
    """Feature hashing of bag-of-words tokens into ``dim`` buckets, L2-normalised.

    Token rule as ``functions.tokens`` (lower case, runs of 2+ letters, digits
    or ``_``); bucket = first 8 hex digits of md5(token) mod ``dim``.  A text
    without tokens maps to the zero vector.
    """

    def __init__(self, dim: int = 64):
        import regex

        self.dim = int(dim)
        self._tok = regex.compile(r"[\p{L}\p{N}_]{2,}")
        self._buckets: dict[str, int] = {}

    def embed(self, texts):
        import numpy as np

        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        cache = self._buckets
        for i, t in enumerate(texts):
            row = out[i]
            for tok in self._tok.findall((t or "").lower()):
                b = cache.get(tok)
                if b is None:
                    if len(cache) > 1_000_000:
                        cache.clear()
                    b = cache[tok] = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
                row[b] += 1.0
        norms = np.sqrt((out * out).sum(axis=1))
        norms[norms == 0] = 1.0
        return (out / norms[:, None]).tolist()


@embedder("openai")
class OpenAIEmbedder:
    """OpenAI-compatible ``/embeddings``."""

    def __init__(self, model: str, base_url: str = "https://api.openai.com/v1", api_key: str = "",
                 request_timeout: float = 10, max_retries: int = 3):
        self.model, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key
        self.timeout, self.retries = request_timeout, max_retries

    def endpoint(self):
        return f"{self.base_url}/embeddings", {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}

    def embed(self, texts):
        url, headers = self.endpoint()
        out = _post_json(url, {"model": self.model, "input": list(texts)}, headers, self.timeout, self.retries)
        return [d["embedding"] for d in sorted(out["data"], key=lambda d: d["index"])]


@embedder("azure-openai")
class AzureOpenAIEmbedder(OpenAIEmbedder):
    """Azure OpenAI embeddings (see :class:`AzureOpenAIChatClient`)."""

    def __init__(self, deployment: str, base_url: str, api_version: str, api_key: str = "", model: str | None = None,
                 **params):
        super().__init__(model or deployment, base_url=base_url, api_key=api_key, **params)
        self.deployment, self.api_version = deployment, api_version

    def endpoint(self):
        return (_azure_url(self.base_url, self.deployment, "embeddings", self.api_version),
                {"api-key": self.api_key})


# ------------------------------------------------------------ vector stores
#
# A store client takes one batch: ``write(list[dict], key) -> None``, where
# ``key`` names the batch by its partition and index (the same on a retried
# task; network clients need not use it).  Records are
# ``{"id", "vector", "metadata"}`` (the Pinecone-style upsert shape) or plain
# field dicts ``{"vector", field: value, ...}`` (the Milvus-style insert shape).

VECTOR_STORES: dict[str, type] = {}


def vector_store(name):
    def deco(cls):
        VECTOR_STORES[name] = cls
        return cls
    return deco


def make_vector_store(opts: dict):
    return _build(VECTOR_STORES, opts)


@vector_store("pinecone")
class PineconeStore:
    """Pinecone data plane: POST ``{host}/vectors/upsert`` (idempotent by id)."""

    def __init__(self, host: str, api_key: str = "", namespace: str = "", request_timeout: float = 10,
                 max_retries: int = 3):
        self.host, self.api_key, self.namespace = host.rstrip("/"), api_key, namespace
        self.timeout, self.retries = request_timeout, max_retries

    def write(self, records, key=None):
        body = {"vectors": [{"id": r["id"], "values": r["vector"], "metadata": r.get("metadata") or {}}
                            for r in records]}
        if self.namespace:
            body["namespace"] = self.namespace
        _post_json(f"{self.host}/vectors/upsert", body, {"Api-Key": self.api_key}, self.timeout, self.retries)


@vector_store("milvus")
class MilvusStore:
    """Milvus REST: POST ``{uri}/v2/vectordb/entities/insert`` (or ``/upsert``) with field dicts.

    Inserts (the reference's call) are not idempotent: a retried Spark task
    inserts its batches again.  With ``upsert=True`` the rows must carry the
    collection's primary key and a retry replaces instead of duplicating.
    """

    def __init__(self, uri: str, collection: str, token: str = "", request_timeout: float = 10,
                 max_retries: int = 3, upsert: bool = False):
        self.uri, self.collection, self.token = uri.rstrip("/"), collection, token
        self.timeout, self.retries = request_timeout, max_retries
        self.action = "upsert" if upsert else "insert"

    def write(self, rows, key=None):
        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        _post_json(f"{self.uri}/v2/vectordb/entities/{self.action}", {"collectionName": self.collection, "data": rows},
                   headers, self.timeout, self.retries)


@vector_store("jsonl-folder")
class JsonlFolderStore:
    """Recording stand-in: each batch becomes one JSON-lines file under ``path``.

    The file is named by the batch key and appears whole, so a retried task rewrites its own
    files instead of adding new ones; with ``append`` every write adds a file, as a plain insert would.
    ``fail_on`` makes batches fail whose key ends with it.  ``path`` is opened by its scheme and must
    be a folder every executor sees (below the shared checkpoint folder in the registered queries).
    """

    def __init__(self, path: str, append: bool = False, fail_on: str | None = None):
        self.path, self.append, self.fail_on = path.rstrip("/"), append, fail_on

    def write(self, rows, key):
        import uuid

        from ..sources.shared import open_whole

        if self.fail_on is not None and key.endswith(self.fail_on):
            raise RuntimeError(f"stub failure of batch {key}")
        once = f"-{uuid.uuid4().hex}" if self.append else ""
        with open_whole(f"{self.path}/batch-{key}{once}.json") as f:
            f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode("utf-8"))
