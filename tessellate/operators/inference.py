"""Providers, their registry, retries and cache, and inference over partitions."""

from __future__ import annotations

import importlib
import json
import logging
import os
import random
import re
import time
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from contextlib import nullcontext
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import Format
from ..types import FormatError, ProviderError

log = logging.getLogger(__name__)
OUTPUTS = "array<struct<score: double, output: string>>"
_OUTPUTS = pa.list_(pa.struct([("score", pa.float64()), ("output", pa.string())]))
#: HTTP statuses worth another try.
RETRYABLE = frozenset((408, 429, 500, 502, 503, 504))
ENTRY_POINTS, PLUGINS_OFF = "tessellate.providers", "TESSELLATE_DISABLE_PLUGINS"
SECRET = re.compile(r"(?i)api_?key|token|secret|password|authorization")


@dataclass(frozen=True)
class ScoredOutput:
    output: str | None
    score: float | None = None

    def __str__(self) -> str:
        return f"Score: {'-' if self.score is None else f'{self.score:.2f}'}\nOutput: {self.output}"


class Provider(ABC):
    """Answers prompts; made on the driver, sent to the executors, one copy a partition."""

    #: Whether answers are bare (bound by a schema), so that no fences are expected.
    raw_output = False
    #: Whether prompts wait for another machine; only then do threads help.
    remote = True
    #: Variables of the environment that give an API key and a server's address where none is passed.
    key_variables: tuple[str, ...] = ()
    address_variable: str | None = None

    def __init__(self, **settings):
        self.settings = settings

    @abstractmethod
    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        """Outputs for one prompt, best first."""

    def infer(self, prompts: Sequence[str], max_workers: int = 1, pool: ThreadPoolExecutor | None = None, **settings) -> list[Sequence[ScoredOutput]]:
        """Outputs in the order of the prompts; call-time settings win over the provider's; one failure fails the batch.

        A ``pool`` outlives the call; without one, ``max_workers`` above 1 makes one for it.
        """
        merged = self.settings | settings
        if pool is None and max_workers > 1 and len(prompts) > 1:
            with ThreadPoolExecutor(min(max_workers, len(prompts))) as own:
                return list(own.map(lambda p: self.answer(p, **merged), prompts))
        return list((pool.map if pool else map)(lambda p: self.answer(p, **merged), prompts))

    def parse(self, output: str):
        """An output without fences as JSON, or as YAML if the provider was made for that."""
        try:
            return Format(getattr(self, "kind", "json"), fences=False).load(output)
        except FormatError as e:
            raise ValueError(str(e)) from e

    def fences(self, wanted: bool | None = None) -> bool:
        return (not self.raw_output) if wanted is None else wanted


class Rules(Provider):
    """Offline: every match of a named pattern in the prompt's question is an extraction."""

    raw_output = True
    remote = False

    def __init__(self, rules: dict[str, str], **settings):
        super().__init__(**settings)
        self.rules = rules

    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        text = prompt.rpartition("\nQ: ")[2].removesuffix("\nA: ")
        hits = sorted((m.start(), name, m[0]) for name, pattern in self.rules.items() for m in re.finditer(pattern, text))
        items = [{name: hit, f"{name}_attributes": {}} for _, name, hit in hits]
        return [ScoredOutput(json.dumps({"extractions": items}, ensure_ascii=False), 1.0)]


class Replay(Provider):
    """Offline: recorded outputs by prompt; a function may make up what isn't recorded."""

    remote = False

    def __init__(self, outputs: dict[str, str], other: Callable[[str], str] | None = None, **settings):
        super().__init__(**settings)
        self.outputs, self.other = outputs, other

    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        if prompt not in self.outputs and self.other is None:
            raise ProviderError(f"no recorded output for {prompt[:80]!r}")
        return [ScoredOutput(self.outputs[prompt] if prompt in self.outputs else self.other(prompt), 1.0)]


def with_retries(call: Callable[[], str], retries: int = 3, base: float = 1.0, most: float = 16.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call`` again after transient failures, waiting longer each time, with jitter; others fail at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "code", getattr(e, "status", None))
            transient = status in RETRYABLE if status is not None else isinstance(e, (ConnectionError, TimeoutError, OSError))
            if not transient or attempt == retries:
                raise
            sleep(min(most, base * 2**attempt) * random.uniform(0.5, 1.5))
    raise AssertionError


class Http(Provider):
    """JSON over HTTP: posts what ``request`` makes of a prompt, reads the answer with ``read``.

    ``post`` may be replaced, so that protocols can be tested without a network.
    """

    def __init__(self, url: str, headers: dict | None = None, timeout: float = 120.0, retries: int = 3, post: Callable[[str, dict, dict, float], dict] | None = None, **settings):
        super().__init__(**settings)
        self.url, self.headers, self.timeout, self.retries, self.post = url, headers or {}, timeout, retries, post or _post

    def request(self, prompt: str, settings: dict) -> dict:
        raise NotImplementedError

    def read(self, answer: dict) -> str:
        raise NotImplementedError

    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        made = with_retries(lambda: self.read(self.post(self.url, self.request(prompt, settings), self.headers, self.timeout)), self.retries)
        return [ScoredOutput(made, 1.0)]


def _post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}), timeout=timeout) as r:  # noqa: S310
        return json.load(r)


class LocalServer(Http):
    """A local model server's generate call; models of the ``gpt-oss`` family get their JSON prompts by its chat call."""

    address_variable = "OLLAMA_BASE_URL"  # fixed value

    def __init__(self, model: str, url: str = "http://localhost:11434", kind: str = "json", **settings):
        self.chat = kind == "json" and "gpt-oss" in model.lower()
        base = url.rstrip("/").removesuffix("/api/generate").removesuffix("/api/chat")
        super().__init__(f"{base}/api/{'chat' if self.chat else 'generate'}", **settings)
        self.model, self.kind = model, kind
        self.raw_output = kind == "json"

    def request(self, prompt: str, settings: dict) -> dict:
        options = {"temperature": settings.get("temperature", 0.1), "num_ctx": settings.get("num_ctx", 2048)}
        options |= {to: settings[k] for k, to in (("seed", "seed"), ("top_k", "top_k"), ("top_p", "top_p"), ("max_tokens", "num_predict"), ("num_threads", "num_thread")) if settings.get(k) is not None}
        body = {"model": self.model, "stream": False, "think": settings.get("think", False), "keep_alive": settings.get("keep_alive", 300), "options": options}
        if settings.get("stop") is not None:
            body["stop"] = settings["stop"]
        if self.chat:
            system = settings.get("system") or "Answer with one JSON document and nothing around it."
            return body | {"messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        return body | {"prompt": prompt} | ({"format": settings.get("schema") or "json"} if self.kind == "json" else {})

    def read(self, answer: dict) -> str:
        said = answer.get("message") or {} if self.chat else answer
        text = said.get("content" if self.chat else "response")
        if not text and said.get("thinking"):
            raise ProviderError("the server returned its reasoning and no answer; ask with think=False")
        if text is None:
            raise ProviderError(f"an answer without text: {str(answer)[:200]}")
        return text

    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        try:
            return super().answer(prompt, **settings)
        except Exception as e:
            if getattr(e, "code", getattr(e, "status", None)) == 404:
                raise ProviderError(f"the server at {self.url} doesn't have the model {self.model!r}") from e
            raise


class Chat(Http):
    """A chat-completions call with a system message and an optional response schema."""

    key_variables = ("OPENAI_API_KEY", "TESSELLATE_API_KEY")  # fixed values

    PASSED = ("temperature", "max_tokens", "top_p", "seed", "stop", "frequency_penalty", "presence_penalty")

    def __init__(self, model: str, url: str, api_key: str | None = None, kind: str = "json", schema: dict | None = None, **settings):
        if schema is not None and kind != "json":
            raise ProviderError("a response schema needs the JSON format")
        super().__init__(url, {"Authorization": f"Bearer {api_key}"} if api_key else {}, **settings)
        self.model, self.kind, self.schema = model, kind, schema
        self.raw_output = kind == "json"

    def request(self, prompt: str, settings: dict) -> dict:
        system = f"Answer with one {self.kind.upper()} document and nothing around it."
        body = {"model": self.model, "n": 1, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        if self.kind == "json":
            named = {"name": "extractions", "strict": True, "schema": self.schema}
            body["response_format"] = {"type": "json_schema", "json_schema": named} if self.schema else {"type": "json_object"}
        return body | {k: settings[k] for k in self.PASSED if settings.get(k) is not None}

    def read(self, answer: dict) -> str:
        return answer["choices"][0]["message"]["content"]


class Generative(Http):
    """A hosted generate-content call below ``url``: one user turn, an optional response schema, the key as a header."""

    key_variables = ("GEMINI_API_KEY", "TESSELLATE_API_KEY")  # fixed values

    PASSED = {"temperature": "temperature", "max_tokens": "maxOutputTokens", "top_p": "topP", "top_k": "topK", "stop": "stopSequences", "seed": "seed"}

    def __init__(self, model: str, url: str, api_key: str | None = None, kind: str = "json", schema: dict | None = None, **settings):
        if schema is not None and kind != "json":
            raise ProviderError("a response schema needs the JSON format")
        super().__init__(f"{url}/models/{model}:generateContent", {"x-goog-api-key": api_key} if api_key else {}, **settings)
        self.model, self.kind, self.schema = model, kind, schema
        self.raw_output = kind == "json" and schema is not None

    def request(self, prompt: str, settings: dict) -> dict:
        config = {to: settings[k] for k, to in self.PASSED.items() if settings.get(k) is not None}
        if self.schema:
            config |= {"responseMimeType": "application/json", "responseSchema": self.schema}
        return {"contents": [{"role": "user", "parts": [{"text": prompt}]}]} | ({"generationConfig": config} if config else {})

    def read(self, answer: dict) -> str:
        try:
            return "".join(p.get("text", "") for p in answer["candidates"][0]["content"]["parts"])
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError(f"an answer without text: {str(answer)[:200]}") from e


# -- registry --------------------------------------------------------------------------


class Registry:
    """Providers by patterns of model ids: higher priority first, then first come."""

    def __init__(self):
        self.entries: list[tuple[int, re.Pattern, type[Provider] | str]] = []
        self.plugins_loaded = False

    def register(self, *patterns: str, provider: type[Provider] | str, priority: int = 20) -> None:
        """``provider`` is a class, or ``module:Class`` to import when it is asked for."""
        self.entries += [(priority, re.compile(p), provider) for p in patterns]
        self.entries.sort(key=lambda e: -e[0])

    def load_plugins(self) -> None:
        """Entry points of installed packages; a broken one is logged and skipped."""
        if self.plugins_loaded or os.environ.get(PLUGINS_OFF):
            return
        self.plugins_loaded = True
        for point in entry_points(group=ENTRY_POINTS):
            try:
                made = point.load()
                self.register(*getattr(made, "PATTERNS", (f"^{re.escape(point.name)}",)), provider=made)
            except Exception:
                log.exception("provider plug-in %s can't be loaded", point.name)

    @staticmethod
    def _class(provider: type[Provider] | str) -> type[Provider]:
        if isinstance(provider, str):
            module, _, name = provider.partition(":")
            return getattr(importlib.import_module(module), name)
        return provider

    def resolve(self, model_id: str) -> type[Provider]:
        self.load_plugins()
        found = next((p for _, pattern, p in self.entries if pattern.search(model_id)), None)
        if found is None:
            raise ProviderError(f"no provider for {model_id!r}")
        return self._class(found)

    def by_name(self, name: str) -> type[Provider]:
        """By an exact pattern, then by part of a class name, then as a model id."""
        self.load_plugins()
        for _, pattern, p in self.entries:
            if pattern.pattern == name:
                return self._class(p)
        for _, _, p in self.entries:
            if name.lower() in (p if isinstance(p, str) else p.__name__).lower():
                return self._class(p)
        return self.resolve(name)

    def make(self, model_id: str | None = None, provider: str | None = None, key_variable: str | None = None, **settings) -> Provider:
        """A provider by name or model id; the environment gives an API key or a server's address only where none is passed.

        Variables are those of the provider (``key_variables``, ``address_variable``); the
        first that is set counts, and a warning names it if there are more.
        """
        if not model_id and not provider:
            raise ProviderError("neither a model id nor a provider is given")
        kind = self.by_name(provider) if provider else self.resolve(model_id)
        keys = [v for v in ((key_variable,) if key_variable else kind.key_variables) if os.environ.get(v)]
        if keys and settings.get("api_key") is None:
            settings["api_key"] = os.environ[keys[0]]
            if len(keys) > 1:
                warnings.warn(f"several API keys are set ({', '.join(keys)}); {keys[0]} is used", stacklevel=2)
        if kind.address_variable and os.environ.get(kind.address_variable) and settings.get("url") is None:
            settings["url"] = os.environ[kind.address_variable]
        try:
            return kind(**({"model": model_id} if model_id and "model" not in settings else {}), **settings)
        except (TypeError, ValueError) as e:
            raise ProviderError(f"{kind.__name__} can't be made: {e}") from e


REGISTRY = Registry()
# Beginnings of model ids (fixed values).
REGISTRY.register(r"^gemini", provider=Generative, priority=10)
REGISTRY.register(r"^gpt-", r"^gpt[45]\.", r"^o\d", provider=Chat, priority=10)
REGISTRY.register(r"^llama", r"^mistral", r"^mixtral", r"^codestral", r"^qwen", r"^phi", r"^gemma", r"^deepseek", r"^command-r", r"^starcoder", r"^codellama", r"^codegemma", r"^tinyllama", r"^wizardcoder", r"^gpt-oss", r"^[\w.-]+/[\w.-]+$", provider=LocalServer, priority=11)


def redacted(settings: dict, chars: int = 500) -> dict:
    """Settings for a log: secrets hidden, long values cut."""
    return {k: "***" if SECRET.search(k) else (v[:chars] + "…" if isinstance(v, str) and len(v) > chars else v) for k, v in settings.items()}


class Logged(Provider):
    """Another provider, whose calls are logged: settings without secrets, the beginnings of prompts and outputs, how long each took."""

    def __init__(self, provider: Provider, chars: int = 500, level: int = logging.DEBUG):
        super().__init__(**provider.settings)
        self.provider, self.chars, self.level = provider, chars, level
        self.raw_output, self.remote = provider.raw_output, provider.remote

    def _short(self, text: str | None) -> str:
        return repr(text) if text is None or len(text) <= self.chars else f"{text[: self.chars]!r} and {len(text) - self.chars} more"

    def answer(self, prompt: str, **settings) -> Sequence[ScoredOutput]:
        name, began = type(self.provider).__name__, time.perf_counter()
        log.log(self.level, "%s is asked %s with %s", name, self._short(prompt), redacted(settings, self.chars))
        try:
            outputs = self.provider.answer(prompt, **settings)
        except Exception as e:
            log.log(self.level, "%s failed after %.3f s: %s: %s", name, time.perf_counter() - began, type(e).__name__, self._short(str(e)))
            raise
        log.log(self.level, "%s answered after %.3f s: %s", name, time.perf_counter() - began, "; ".join(self._short(o.output) for o in outputs))
        return outputs


# -- over DataFrames -------------------------------------------------------------------


def infer(prompts: DataFrame, provider: Provider, prompt_col: str = "prompt", batch: int = 10, max_workers: int = 10, **settings) -> DataFrame:
    """``prompts`` with ``outputs``: what the provider answers, best first.

    A provider that returns fewer answers than it got prompts raises.  Write the result
    before using it twice: a lost partition would be asked again.
    """

    @F.arrow_udf(OUTPUTS)
    def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(max_workers) if provider.remote and max_workers > 1 else nullcontext() as pool:
            more = {"pool": pool} if pool else {}
            for texts in batches:
                made = []
                for at in range(0, len(texts), batch):
                    part = texts.slice(at, batch).to_pylist()
                    answers = list(provider.infer(part, **more, **settings))
                    if len(answers) != len(part):
                        raise ProviderError(f"{len(part)} prompts, {len(answers)} answers")
                    best = [sorted(a, key=lambda o: -(o.score if o.score is not None else 0.0)) for a in answers]
                    made.append(pa.array([[{"score": o.score, "output": o.output} for o in a] for a in best], _OUTPUTS))
                yield pa.concat_arrays(made) if made else pa.array([], _OUTPUTS)

    return prompts.withColumn("outputs", asked.asNondeterministic()(F.col(prompt_col)))


def request_key(prompt: Column, model_id: str, settings: dict | None = None) -> Column:
    """SHA-256 of the canonical JSON of model, settings and prompt."""
    fixed = json.dumps({"model": model_id, "settings": settings or {}}, sort_keys=True, ensure_ascii=False)
    return F.sha2(F.concat_ws("\x1f", F.lit(fixed), prompt), 256)


def format_for(provider: Provider, kind: str = "json", fences: bool | None = None, **options) -> Format:
    return Format(kind=kind, fences=provider.fences(fences), **options)
