import json

import pytest

from quire.operators import engines
from quire.operators.engines import Settings, client
from quire.operators.memory import Refused, Retry


def transport(answer, status=200, seen=None):
    def call(method, address, headers, body):
        if seen is not None:
            seen.append((method, address, dict(headers), json.loads(body) if body and body[:1] in b"{[" else body))
        return status, answer if isinstance(answer, str) else json.dumps(answer)

    return call


def chat(content):
    return {"choices": [{"message": {"content": content}}]}


def test_unknown_service():
    with pytest.raises(ValueError, match="unknown"):
        engines.engine("nobody", "en", "zh")


@pytest.mark.parametrize("name", [n for n in engines.CHAT if n not in ("azure-openai",)])
def test_chat_services(name):
    seen = []
    given = {k: f"https://{name}.test/v1" for k in engines.SERVICES[name]["settings"] if k.endswith("BASE_URL")}
    given |= {k: "key" for k in engines.SERVICES[name]["settings"] if k.endswith("API_KEY")}
    settings = Settings.of(name, given=given, environ={})
    call = client(name, "en", "zh", settings, "model", "To ${lang_out}: ${text}", transport(chat("<think>hm</think>\n你好 <think>x</think>"), seen=seen))
    assert call("hello") == "你好 <think>x</think>"
    method, address, headers, body = seen[0]
    assert method == "POST" and address.endswith("/chat/completions") and headers["Authorization"] == "Bearer key" and body["model"] == "model"
    assert body["messages"][0]["content"] == ("hello" if name == "qwen-mt" else "To zh: hello")


def test_mandatory_settings():
    with pytest.raises(ValueError, match="base address"):
        engines.engine("openailiked", "en", "zh")
    with pytest.raises(ValueError, match="base address"):
        engines.engine("openailiked", "en", "zh", given={"OPENAILIKED_BASE_URL": "https://x"})
    assert engines.engine("openailiked:m", "en", "zh", given={"OPENAILIKED_BASE_URL": "https://x"}).model == "m"


def test_settings_precedence():
    s = Settings.of("openai", {"OPENAI_MODEL": "stored", "OPENAI_API_KEY": "stored"}, {"OPENAI_API_KEY": "given"}, {"OPENAI_MODEL": "environment"})
    assert (s.get("_MODEL"), s.get("API_KEY"), s.get("BASE_URL")) == ("environment", "given", "https://api.openai.com/v1")


def test_prompt_is_part_of_the_key():
    a, b = (engines.engine("groq", "en", "zh", template=t) for t in ("A ${text}", "B ${text}"))
    assert a.key != b.key and engines.engine("google", "en", "zh").key != engines.engine("google", "en", "fr").key


def test_rate_limits_and_errors():
    s = Settings.of("openai", environ={})
    with pytest.raises(Retry):
        client("openai", "en", "zh", s, transport=transport("slow down", 429))("x")
    with pytest.raises(Refused):
        client("zhipu", "en", "zh", Settings.of("zhipu", environ={}), transport=transport({"error": "filtered"}))("x")


def test_page_services():
    seen = []
    page = '<div class="result-container">a &amp; b\u0007</div>'
    assert client("google", "en", "zh", Settings(), transport=transport(page, seen=seen))("t" * 6000) == "a & b"
    assert "tl=zh-CN" in seen[0][1] and "q=" + "t" * 5000 in seen[0][1] and "t" * 5001 not in seen[0][1]
    with pytest.raises(Refused):
        client("google", "en", "zh", Settings(), transport=transport("", 400))("x")


def test_scraped_tokens():
    page = '"ig":"IG1" data-iid="a" data-iid="last" params_AbusePreventionHelper = [17,"tok",3]'

    def call(method, address, headers, body):
        if method == "GET":
            return 200, page
        assert "IG=IG1&IID=last" in address and b"to=zh-Hans" in body and b"token=tok" in body and b"key=17" in body
        return 200, json.dumps([{"translations": [{"text": "ok"}]}])

    assert client("bing", "en", "zh", Settings(), transport=call)("x") == "ok"


def test_other_services():
    def settings(name, **given):
        return Settings.of(name, given=given, environ={})

    seen = []
    assert client("ollama", "en", "zh", settings("ollama"), "m", None, transport({"message": {"content": "<think>a</think> ok "}}, seen=seen))("x" * 500) == "ok"
    assert seen[0][3]["options"]["num_predict"] == 2500
    assert client("xinference", "en", "zh", settings("xinference"), "bad;good", None, lambda m, a, h, b: (200, json.dumps(chat("ok<end_of_turn>"))) if json.loads(b)["model"] == "good" else (500, ""))("x") == "ok"
    assert client("deepl", "en", "zh", settings("deepl", DEEPL_AUTH_KEY="k"), transport=transport({"translations": [{"text": "ok"}]}))("x") == "ok"
    assert client("deeplx", "en", "zh", settings("deeplx"), transport=transport({"data": "ok"}))("x") == "ok"
    assert client("azure", "en", "zh", settings("azure"), transport=transport([{"translations": [{"text": "ok"}]}]))("x") == "ok"
    assert client("anythingllm", "en", "zh", settings("anythingllm", AnythingLLM_URL="https://x"), transport=transport({"textResponse": " ok "}))("x") == "ok"
    assert client("dify", "en", "zh", settings("dify", DIFY_API_URL="https://x"), transport=transport({"answer": "ok"}))("x") == "ok"
    assert client("tencent", "en", "zh", settings("tencent", TENCENTCLOUD_SECRET_ID="i", TENCENTCLOUD_SECRET_KEY="k"), transport=transport({"Response": {"TargetText": "ok"}}))("x") == "ok"
    with pytest.raises(RuntimeError, match="not installed"):
        client("argos", "en", "zh", settings("argos"))("x")


def test_registry(spark):
    rows = {r.name: r for r in engines.registry(spark).collect()}
    assert len(rows) == 22 and rows["google"].aliases == {"zh": "zh-CN"} and not rows["argos"].cacheable and rows["bing"].max_chars == 1000
