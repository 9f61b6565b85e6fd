"""Translation services: their settings, and clients made once for a worker.

A client is a function text -> text. It talks through a transport, a function of method,
address, headers and body that gives status and answer; tests give their own.
"""

from __future__ import annotations

import html
import json
import os
import re
import unicodedata
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quire.functions import text as tx
from quire.functions import values
from quire.operators.memory import Engine, Refused, Retry, first_success

Transport = Callable[[str, str, Mapping[str, str], bytes | None], tuple[int, str]]

# The registry's names, language aliases, settings with their defaults.
SERVICES: dict[str, dict] = {
    "google": {"aliases": {"zh": "zh-CN"}, "settings": {}},
    "bing": {"aliases": {"zh": "zh-Hans"}, "settings": {}},
    "deepl": {"aliases": {"zh": "zh-Hans"}, "settings": {"DEEPL_AUTH_KEY": None}},
    "deeplx": {"aliases": {"zh": "zh-Hans"}, "settings": {"DEEPLX_ENDPOINT": "https://api.deepl.com/translate", "DEEPLX_ACCESS_TOKEN": None}},
    "ollama": {"prompt": True, "settings": {"OLLAMA_HOST": "http://127.0.0.1:11434", "OLLAMA_MODEL": "gemma2"}},
    "xinference": {"prompt": True, "settings": {"XINFERENCE_HOST": "http://127.0.0.1:9997", "XINFERENCE_MODEL": "gemma-2-it"}},
    "openai": {"prompt": True, "settings": {"OPENAI_BASE_URL": "https://api.openai.com/v1", "OPENAI_API_KEY": None, "OPENAI_MODEL": "gpt-4o-mini"}},
    "azure-openai": {"prompt": True, "settings": {"AZURE_OPENAI_BASE_URL": None, "AZURE_OPENAI_API_KEY": None, "AZURE_OPENAI_MODEL": "gpt-4o-mini", "AZURE_OPENAI_API_VERSION": "2024-06-01"}},
    "modelscope": {"prompt": True, "settings": {"MODELSCOPE_BASE_URL": "https://api-inference.modelscope.cn/v1", "MODELSCOPE_API_KEY": None, "MODELSCOPE_MODEL": "Qwen/Qwen2.5-32B-Instruct"}},
    "zhipu": {"prompt": True, "settings": {"ZHIPU_API_KEY": None, "ZHIPU_MODEL": "glm-4-flash"}, "base": "https://open.bigmodel.cn/api/paas/v4"},
    "silicon": {"prompt": True, "settings": {"SILICON_API_KEY": None, "SILICON_MODEL": "Qwen/Qwen2.5-7B-Instruct"}, "base": "https://api.siliconflow.cn/v1"},
    "gemini": {"prompt": True, "settings": {"GEMINI_API_KEY": None, "GEMINI_MODEL": "gemini-1.5-flash"}, "base": "https://generativelanguage.googleapis.com/v1beta/openai"},
    "azure": {"aliases": {"zh": "zh-Hans"}, "settings": {"AZURE_ENDPOINT": "https://api.translator.azure.cn", "AZURE_API_KEY": None}},
    "tencent": {"settings": {"TENCENTCLOUD_SECRET_ID": None, "TENCENTCLOUD_SECRET_KEY": None}},
    "anythingllm": {"prompt": True, "settings": {"AnythingLLM_URL": None, "AnythingLLM_APIKEY": None}},
    "dify": {"settings": {"DIFY_API_URL": None, "DIFY_API_KEY": None}},
    "argos": {"settings": {}, "cacheable": False},
    "grok": {"prompt": True, "settings": {"GROK_API_KEY": None, "GROK_MODEL": "grok-2-1212"}, "base": "https://api.x.ai/v1"},
    "groq": {"prompt": True, "settings": {"GROQ_API_KEY": None, "GROQ_MODEL": "llama-3-3-70b-versatile"}, "base": "https://api.groq.com/openai/v1"},
    "deepseek": {"prompt": True, "settings": {"DEEPSEEK_API_KEY": None, "DEEPSEEK_MODEL": "deepseek-chat"}, "base": "https://api.deepseek.com/v1"},
    "openailiked": {"prompt": True, "settings": {"OPENAILIKED_BASE_URL": None, "OPENAILIKED_API_KEY": None, "OPENAILIKED_MODEL": None}},
    "qwen-mt": {"prompt": True, "settings": {"ALI_MODEL": "qwen-mt-turbo", "ALI_API_KEY": None}, "base": "https://dashscope.aliyuncs.com/compatible-mode/v1"},
}
# Addresses of the services that have no setting for them, and what their pages
# hold the answer or the request's marks in.
GOOGLE_PAGE = "https://translate.google.com/m"
GOOGLE_ANSWER = r'(?s)class="(?:t0|result-container)">(.*?)<'
BING_PAGE = "https://www.bing.com/translator"
BING_ANSWER = "https://www.bing.com/ttranslatev3"
BING_IG = r'"ig":"(.*?)"'
BING_IID = r'data-iid="(.*?)"'
BING_TOKEN = r'params_AbusePreventionHelper\s=\s\[(.*?),"(.*?)",'
END_OF_TURN = "<end_of_turn>"

CHAT = ("openai", "azure-openai", "modelscope", "zhipu", "silicon", "gemini", "grok", "groq", "deepseek", "openailiked", "qwen-mt")


def service(name: str) -> dict:
    if name not in SERVICES:
        raise ValueError(f"unknown translation service: {name!r}")
    return SERVICES[name]


def registry(spark: SparkSession) -> DataFrame:
    """name, aliases, custom_prompt, max_chars, cacheable: one row for each service."""
    limits = {"google": values.GOOGLE_CHARS, "bing": values.BING_CHARS}
    rows = [(n, s.get("aliases", {}), bool(s.get("prompt")), limits.get(n), s.get("cacheable", True)) for n, s in SERVICES.items()]
    return spark.createDataFrame(rows, "name string, aliases map<string,string>, custom_prompt boolean, max_chars int, cacheable boolean")


def http(method: str, address: str, headers: Mapping[str, str], body: bytes | None, timeout: float = 60) -> tuple[int, str]:
    """The usual transport: certificates are checked, redirects followed."""
    request = urllib.request.Request(address, data=body, headers=dict(headers), method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as failure:
        return failure.code, failure.read().decode("utf-8", "replace")


@dataclass(frozen=True)
class Settings:
    """Stored settings, then the environment, then what the caller gives; nothing is written back."""

    values: Mapping[str, str | None] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, stored: Mapping[str, str | None] | None = None, given: Mapping[str, str | None] | None = None, environ: Mapping[str, str] | None = None) -> Settings:
        out = dict(service(name)["settings"]) | {k: v for k, v in (stored or {}).items()}
        env = os.environ if environ is None else environ
        out |= {k: env[k] for k in out if k in env}
        return cls(out | dict(given or {}))

    def get(self, suffix: str, default: str | None = None) -> str | None:
        for k, v in self.values.items():
            if k.upper().endswith(suffix.upper()) and v is not None:
                return v
        return default


def _json(transport: Transport, address: str, body: object, headers: Mapping[str, str]) -> dict | list:
    status, said = transport("POST", address, {"Content-Type": "application/json", **headers}, json.dumps(body).encode())
    if status == 429:
        raise Retry(f"rate limit: {said[:200]}")
    if status >= 400:
        raise RuntimeError(f"status {status}: {said[:200]}")
    return json.loads(said)


def clean_answer(content: str, tolerant: bool = True) -> str:
    """Without a leading thought block."""
    return re.sub(values.THOUGHT_TOLERANT if tolerant else values.THOUGHT, "", content.strip() if tolerant else content, count=1, flags=re.DOTALL).strip()


def fill(template: str | None, lang_in: str, lang_out: str, text: str) -> list[dict[str, str]]:
    """The message of a chat; a template that cannot be used gives way to the default."""
    from string import Template

    said = Template(template or tx.DEFAULT_TEMPLATE).safe_substitute(lang_in=lang_in, lang_out=lang_out, text=text)
    return [{"role": "user", "content": said}]


def _budget(text: str) -> int:
    return max(2000, 5 * len(text))


def client(name: str, lang_in: str, lang_out: str, settings: Settings, model: str | None = None, template: str | None = None, transport: Transport = http) -> Callable[[str], str]:
    """A client of the named service."""
    aliases = service(name).get("aliases", {})
    lin, lout = (aliases.get(x.lower(), x) for x in (lang_in, lang_out))
    key = settings.get("API_KEY") or settings.get("APIKEY") or settings.get("AUTH_KEY") or settings.get("ACCESS_TOKEN")
    model = model or settings.get("_MODEL")
    bearer = {"Authorization": f"Bearer {key}"} if key else {}

    def chat(text: str) -> str:
        base = settings.get("BASE_URL") or service(name).get("base")
        if name in ("openailiked", "azure-openai") and not base:
            raise ValueError(f"{name} needs a base address")
        if not model:
            raise ValueError(f"{name} needs a model")
        if name == "azure-openai":
            address, auth = f"{base}/openai/deployments/{model}/chat/completions?api-version={settings.get('API_VERSION')}", {"api-key": key or ""}
        else:
            address, auth = f"{base}/chat/completions", bearer or {"Authorization": "Bearer none"}
        body = {"model": model, "temperature": 0, "messages": fill(template, lang_in, lang_out, text)}
        if name == "qwen-mt":
            body["messages"] = [{"role": "user", "content": text}]
            body["translation_options"] = {"source_lang": values.LANGUAGE_WORDS[lang_in], "target_lang": values.LANGUAGE_WORDS[lang_out]}
        got = _json(transport, address, body, auth)
        if not got.get("choices"):
            raise Refused(str(got.get("error", "no answer"))) if name == "zhipu" else RuntimeError(str(got.get("error", "no answer")))
        return clean_answer(got["choices"][0]["message"]["content"])

    def ollama(text: str) -> str:
        got = _json(transport, f"{settings.get('HOST')}/api/chat", {"model": model, "stream": False, "messages": fill(template, lang_in, lang_out, text), "options": {"temperature": 0, "num_predict": _budget(text)}}, {})
        return clean_answer(got["message"]["content"] or "", tolerant=False)

    def xinference(text: str) -> str:
        def ask(one: str) -> str:
            got = _json(transport, f"{settings.get('HOST')}/v1/chat/completions", {"model": one, "temperature": 0, "messages": fill(template, lang_in, lang_out, text)}, {})
            said = got["choices"][0]["message"]["content"].replace(END_OF_TURN, "")
            if len(said) > _budget(text):
                raise RuntimeError("the answer is too long")
            return said.strip()

        return first_success((model or "").split(";"), ask)

    def google(text: str) -> str:
        query = urllib.parse.urlencode({"tl": lout, "sl": lin, "q": text[: values.GOOGLE_CHARS]})
        status, page = transport("GET", f"{GOOGLE_PAGE}?{query}", {"User-Agent": "Mozilla/4.0"}, None)
        if status == 400:
            raise Refused(values.REFUSED)
        if status >= 400:
            raise Retry(f"status {status}")
        found = re.findall(GOOGLE_ANSWER, page)
        return "".join(c for c in html.unescape(found[0]) if unicodedata.category(c)[0] != "C")

    def bing(text: str) -> str:
        status, page = transport("GET", BING_PAGE, {"User-Agent": "Mozilla/5.0"}, None)
        ig = re.findall(BING_IG, page)[0]
        iid = re.findall(BING_IID, page)[-1]
        mark, token = re.findall(BING_TOKEN, page)[0]
        form = urllib.parse.urlencode({"fromLang": lin, "to": lout, "text": text[: values.BING_CHARS], "token": token, "key": mark}).encode()
        status, said = transport("POST", f"{BING_ANSWER}?IG={ig}&IID={iid}", {"User-Agent": "Mozilla/5.0", "Content-Type": "application/x-www-form-urlencoded"}, form)
        if status >= 400:
            raise Retry(f"status {status}")
        return json.loads(said)[0]["translations"][0]["text"]

    def deepl(text: str) -> str:
        got = _json(transport, "https://api-free.deepl.com/v2/translate", {"text": [text], "source_lang": lin.upper(), "target_lang": lout.upper()}, {"Authorization": f"DeepL-Auth-Key {key}"})
        return got["translations"][0]["text"]

    def deeplx(text: str) -> str:
        return _json(transport, settings.get("ENDPOINT"), {"source_lang": lin, "target_lang": lout, "text": text}, bearer)["data"]

    def azure(text: str) -> str:
        address = f"{settings.get('ENDPOINT')}/translate?api-version=3.0&from={lin}&to={lout}"
        return _json(transport, address, [{"Text": text}], {"Ocp-Apim-Subscription-Key": key or "", "Ocp-Apim-Subscription-Region": "chinaeast2"})[0]["translations"][0]["text"]

    def anythingllm(text: str) -> str:
        got = _json(transport, settings.get("URL"), {"message": fill(template, lang_in, lang_out, text)[0]["content"], "mode": "chat"}, bearer)
        if "textResponse" not in got:
            raise RuntimeError("the answer holds no text")
        return got["textResponse"].strip()

    def dify(text: str) -> str:
        got = _json(transport, settings.get("API_URL"), {"inputs": {"lang_out": lang_out, "lang_in": lang_in, "text": text}, "response_mode": "blocking", "user": "quire"}, bearer)
        return got["answer"]

    def tencent(text: str) -> str:
        return _signed_tencent(transport, settings, lin, lout, text)

    def argos(text: str) -> str:
        try:
            import argostranslate.translate as local
        except ModuleNotFoundError as missing:
            raise RuntimeError("the local model's package is not installed") from missing
        return local.translate(text, lin, lout)

    if name in CHAT:
        return chat
    return {"ollama": ollama, "xinference": xinference, "google": google, "bing": bing, "deepl": deepl, "deeplx": deeplx, "azure": azure, "anythingllm": anythingllm, "dify": dify, "tencent": tencent, "argos": argos}[name]


def _signed_tencent(transport: Transport, settings: Settings, lin: str, lout: str, text: str) -> str:
    """The TextTranslate action with the cloud's published request signature."""
    import hashlib
    import hmac
    import time

    host, now = "tmt.tencentcloudapi.com", int(time.time())
    day = time.strftime("%Y-%m-%d", time.gmtime(now))
    body = json.dumps({"SourceText": text, "Source": lin, "Target": lout, "ProjectId": 0}).encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    mac = lambda k, m: hmac.new(k, m.encode(), hashlib.sha256).digest()
    request = f"POST\n/\n\ncontent-type:application/json\nhost:{host}\n\ncontent-type;host\n{sha(body)}"
    scope = f"{day}/tmt/tc3_request"
    signing = mac(mac(mac(("TC3" + (settings.get("SECRET_KEY") or "")).encode(), day), "tmt"), "tc3_request")
    signature = mac(signing, f"TC3-HMAC-SHA256\n{now}\n{scope}\n{sha(request.encode())}").hex()
    headers = {"Content-Type": "application/json", "Host": host, "X-TC-Action": "TextTranslate", "X-TC-Version": "2018-03-21", "X-TC-Region": "ap-beijing", "X-TC-Timestamp": str(now), "Authorization": f"TC3-HMAC-SHA256 Credential={settings.get('SECRET_ID')}/{scope}, SignedHeaders=content-type;host, Signature={signature}"}
    status, said = transport("POST", f"https://{host}", headers, body)
    if status >= 400:
        raise Retry(f"status {status}")
    return json.loads(said)["Response"]["TargetText"]


def engine(spec: str, lang_in: str, lang_out: str, stored: Mapping | None = None, given: Mapping | None = None, template: str | None = None, transport: Transport = http) -> Engine:
    """An engine from "name" or "name:model". The prompt is always part of its key."""
    name, _, model = spec.partition(":")
    settings = Settings.of(name, stored, given)
    model = model or settings.get("_MODEL") or ""
    if name == "openailiked" and not (settings.get("BASE_URL") and model):
        raise ValueError("openailiked needs a base address and a model")
    params: dict[str, object] = {"temperature": 0} if name in CHAT or name in ("ollama", "xinference") else {}
    if service(name).get("prompt"):
        params["prompt"] = template or tx.DEFAULT_TEMPLATE
    return Engine(name, lang_in, lang_out, model, lambda: client(name, lang_in, lang_out, settings, model or None, template, transport), params, service(name).get("cacheable", True))
