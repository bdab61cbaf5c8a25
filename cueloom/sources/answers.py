"""Answers of models, kept by what was asked."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs


class Answers:
    """A folder that all executors share, with one small file for each (model, prompt): its name is the
    digest of both, so whoever asks the same finds it, in this job or a later one."""

    def __init__(self, folder: str, model: str):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.path, self.model = path.rstrip("/"), model

    def place(self, prompt: str) -> str:
        digest = hashlib.sha256(f"{self.model}\0{prompt}".encode("utf-8", "surrogatepass")).hexdigest()
        return f"{self.path}/{digest[:2]}/{digest}"

    def get(self, prompt: str) -> str | None:
        place = self.place(prompt)
        if self.files.get_file_info(place).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(place) as f:
            return json.loads(f.read())

    def put(self, prompt: str, output: str) -> None:
        """The file appears whole: it is written under another name and moved."""
        place = self.place(prompt)
        self.files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        begun = f"{place}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(begun) as f:
            f.write(json.dumps(output).encode())
        self.files.move(begun, place)
