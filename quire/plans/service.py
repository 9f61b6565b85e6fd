"""Jobs over HTTP: upload a PDF file, ask how it goes, cancel, fetch a result.

POST   /v1/translate               form fields ``file`` and ``data`` (JSON options): {"id"}
GET    /v1/translate/<id>          {"state", "info"}
DELETE /v1/translate/<id>          {"state"}; a job that is over is dropped with its files
GET    /v1/translate/<id>/<kind>   the translated file for ``mono``, the bilingual one else
"""

from __future__ import annotations

import json
from collections.abc import Callable
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from quire.operators import engines, memory
from quire.plans import pipeline
from quire.plans.cli import page_numbers, wide_font
from quire.plans.jobs import Jobs, NotReady
from quire.plans.options import Options
from quire.sources import files, pdf


def form_fields(kind: str, body: bytes) -> dict[str, bytes]:
    """Fields of a multipart form."""
    message = BytesParser(policy=HTTP).parsebytes(f"Content-Type: {kind}\r\n\r\n".encode() + body)
    return {part.get_param("name", header="content-disposition"): part.get_payload(decode=True) for part in message.iter_parts()}


def options_of(data: dict) -> Options:
    pages = data.get("pages")
    numbers = page_numbers(pages) if isinstance(pages, str) else pages
    return Options(data.get("lang_in", "en"), data.get("lang_out", "zh"), data.get("service", "google"), tuple(numbers) if numbers else None, int(data.get("thread", 4)), bool(data.get("ignore_cache")))


def server(
    spark: SparkSession,
    address: tuple[str, int],
    engine: Callable[..., memory.Engine] = engines.engine,
    store: memory.Memory | None = None,
    boxes: Callable[[DataFrame], DataFrame] | None = None,
    fonts: str | None = None,
) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; its jobs run on the given session.

    ``boxes`` gives detections, with the names of their classes, of files (doc_id, content);
    ``fonts`` is a folder of the font files that target languages are set in.
    """
    jobs = Jobs(spark)

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: object, kind: str = "application/json") -> None:
            raw = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _parts(self) -> list[str]:
            parts = self.path.strip("/").split("/")
            return parts[2:] if parts[:2] == ["v1", "translate"] else ["", "", ""]

        def do_POST(self) -> None:
            if self._parts():
                return self._say(404, {"error": "no such address"})
            try:
                fields = form_fields(self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"])))
                options = options_of(json.loads(fields.get("data") or b"{}"))
                chosen = engine(options.service, options.lang_in, options.lang_out)
                content = fields["file"]
            except (KeyError, TypeError, ValueError) as failure:
                return self._say(400, {"error": str(failure)})

            there = pdf.page_count(content)
            total = sum(p < there for p in set(options.pages)) if options.pages else there
            done = spark.sparkContext.accumulator(0)

            def work():
                found = files.from_bytes(spark, [content])
                return pipeline.translate_files(found, boxes(found) if boxes else None, None, chosen, options, store, wide_font(options.lang_out, fonts), done)

            return self._say(200, {"id": jobs.submit(work, total, done)})

        def do_GET(self) -> None:
            parts = self._parts()
            if len(parts) not in (1, 2) or not jobs.known(parts[0]):
                return self._say(404, {"error": "no such job"})
            if len(parts) == 1:
                return self._say(200, jobs.status(parts[0]))
            try:
                content = "mono_content" if parts[1] == "mono" else "dual_content"
                row = jobs.fetch(parts[0]).select(content, "error").first()
                if row.error:
                    raise NotReady(row.error)
            except NotReady as failure:
                return self._say(400, {"error": str(failure)})
            return self._say(200, bytes(row[content]), "application/pdf")

        def do_DELETE(self) -> None:
            parts = self._parts()
            if len(parts) != 1 or not jobs.known(parts[0]):
                return self._say(404, {"error": "no such job"})
            state = jobs.cancel(parts[0])
            if state["state"] in ("SUCCESS", "FAILURE"):
                jobs.forget(parts[0])
            return self._say(200, state)

        def log_message(self, *_: object) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer(address, Handler)
