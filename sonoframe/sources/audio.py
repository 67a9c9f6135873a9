"""PCM files as a Spark data source, and the sink that writes them."""

import fnmatch
import hashlib
import io
import posixpath
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AUDIO_SCHEMA = "path string, sample_rate int, samples array<float>, file_sha256 string, error string"
_ARROW = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("file_sha256", pa.string()), ("error", pa.string())])
PARTITION_BYTES = 64 << 20    # files of one task, at most, unless a single file is larger
BATCH_BYTES = 8 << 20         # file bytes of one Arrow batch, likewise
OPEN_BYTES = 64 << 10         # what opening a file costs, in bytes, so that tiny files are spread too


def decode_pcm(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono float32 samples of an uncompressed PCM file."""
    with wave.open(io.BytesIO(content)) as stream:
        if stream.getcomptype() != "NONE":
            raise ValueError("only uncompressed PCM is supported")
        channels, width, rate = stream.getnchannels(), stream.getsampwidth(), stream.getframerate()
        data = stream.readframes(stream.getnframes())
    if channels < 1 or rate < 1 or len(data) % (width * channels):
        raise ValueError("the frame data is incomplete or the header is invalid")
    if width == 1:
        values = (np.frombuffer(data, np.uint8).astype(np.float32) - 128.0) / 128.0
    elif width in (2, 4):
        values = np.frombuffer(data, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    elif width == 3:
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)  # value sits in the upper three bytes
        values = (wide.reshape(-1).view("<i4") >> 8).astype(np.float32) / 8388608.0
    else:
        raise ValueError("unsupported sample width")
    return rate, values.reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else values


def encode_pcm(samples: np.ndarray, rate: int, width: int) -> bytes:
    """One-channel PCM file of samples from -1 to 1, rounded down to the width's steps."""
    scale = float(1 << (8 * width - 1))
    steps = np.clip(np.floor(np.asarray(samples, np.float64) * scale), -scale, scale - 1).astype("<i8")
    if width == 1:
        steps = steps + 128
    data = steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as stream:
        stream.setnchannels(1)
        stream.setsampwidth(width)
        stream.setframerate(rate)
        stream.writeframes(data)
    return out.getvalue()


def _opened(path: str):
    """File system of a path or URI, the path within it, and the prefix that makes such a path a URI as Spark writes it."""
    from pyarrow import fs

    local = path.removeprefix("file:")
    if local.startswith("/"):
        return fs.LocalFileSystem(), "/" + local.lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[:path.index(inner)] if inner in path else path.split("://")[0] + "://"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.wav")
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[_Files]:
        """Names and sizes are listed here; contents are read by the tasks."""
        from pyarrow import fs

        system, inner, _ = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(posixpath.basename(f.path), self.pattern))
        groups, held = [], 0
        for path, size in files:
            if not groups or held + size + OPEN_BYTES > self.most:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size + OPEN_BYTES
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            digest = hashlib.sha256(content).hexdigest() if content else ""
            try:
                rate, samples = decode_pcm(content)
                rows.append((prefix + path, rate, samples, digest, None))
            except (ValueError, EOFError, wave.Error) as error:
                rows.append((prefix + path, None, None, digest, f"{type(error).__name__}: {error}"))
            held += len(content) + OPEN_BYTES
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    sizes = [0 if s is None else len(s) for s in columns[2]]
    values = np.concatenate([np.zeros(0, np.float32), *[s for s in columns[2] if s is not None]])
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype("int32"))
    missing = pa.array([s is None for s in columns[2]])
    samples = pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()), mask=missing)
    return pa.RecordBatch.from_arrays([
        pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), samples, pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], schema=_ARROW)


class AudioFiles(DataSource):
    """Format ``audio_files``: a row per PCM file below ``path`` whose name matches ``pattern``.

    Columns as in ``AUDIO_SCHEMA``.  Files without bytes and files that cannot be decoded are rows with ``error`` set.
    """

    @classmethod
    def name(cls) -> str:
        return "audio_files"

    def schema(self) -> str:
        return AUDIO_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _write(folder: str, width_given: bool):
    def run(batches):
        system, inner, prefix = _opened(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            paths = []
            for at, name in enumerate(batch.column("name").to_pylist()):
                path = f"{inner.rstrip('/')}/{name}.wav"
                samples = batch.column("samples")[at]
                width = batch.column("width")[at].as_py() if width_given else 2
                values = np.asarray(samples.values.fill_null(0)) if samples.is_valid else np.zeros(0)
                with system.open_output_stream(path) as stream:
                    stream.write(encode_pcm(values, batch.column("sample_rate")[at].as_py(), width))
                paths.append(prefix + path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return run


def write_audio(df: DataFrame, folder: str) -> int:
    """One-channel PCM files ``<name>.wav`` of rows ``name, sample_rate, samples`` and, if given, ``width`` in bytes; returns their number.

    A task that runs again writes the same files again.  Names have to be unique and free of slashes.
    """
    wanted = ["name", "sample_rate", "samples", *(["width"] if "width" in df.columns else [])]
    return df.select(*wanted).mapInArrow(_write(folder, "width" in df.columns), "path string").count()
