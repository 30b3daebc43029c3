"""Media operators. Paths come in array columns; what reads a file is a backend ``(path, **params) -> value``.

File sizes, the shapes of PNG, GIF and JPEG images, the length of WAV files and equal
files need no model and are built in; the rest raises BackendMissing until a backend
is given in the context. Values are computed in Arrow batches, once for each distinct
path of a batch; predicates are native. A row without media is kept.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import struct
import sys
import wave
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import text_hash
from .filters import first_of
from .registry import BackendMissing, Context, register

IMAGE_TOKEN, AUDIO_TOKEN, VIDEO_TOKEN, CHUNK_END = "<__dj__image>", "<__dj__audio>", "<__dj__video>", "<|__dj__eoc|>"


def need(ctx: Context, name: str, default=None):
    found = ctx.backends.get(name, default)
    if found is None:
        raise BackendMissing(f"{name} needs a backend: Context(backends={{'{name}': ...}})")
    return found


def _declare(name: str, kind: str, params: dict, fn) -> None:
    """Register ``fn(df, ctx, params)`` under explicit parameters and defaults."""

    def run(df: DataFrame, ctx: Context, **given) -> DataFrame:
        return fn(df, ctx, params | given)

    run.__doc__ = fn.__doc__
    run.__signature__ = inspect.Signature(
        [inspect.Parameter("df", 1), inspect.Parameter("ctx", 1), *(inspect.Parameter(k, 3, default=v) for k, v in params.items())]
    )
    register(name, kind, tier="X")(run)


def bytes_of(text: str | int) -> int:
    """'10kb', '1.5 MB' or a plain number in bytes."""
    t = str(text).strip().lower().replace("ib", "").rstrip("b").strip()
    power = "kmgtp".find(t[-1:]) + 1 if t[-1:].isalpha() else 0
    return int(float(t[:-1] if power else t) * 1024**power)


def image_shape(path: str, **_) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF or JPEG file."""
    with open(path, "rb") as f:
        head = f.read(32)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:3] == b"GIF":
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"\xff\xd8":
            f.seek(2)
            while True:
                marker, kind, size = struct.unpack(">BBH", f.read(4))
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">xHH", f.read(5))
                    return width, height
                f.seek(size - 2, 1)
    raise ValueError(f"{path} is no image that can be read here")


def wav_seconds(path: str, **_) -> float:
    with wave.open(path) as f:
        return f.getnframes() / f.getframerate()


def file_digest(path: str, **_) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def values(df: DataFrame, column: str, fn, params: dict, kind: str, name: str = "_values") -> DataFrame:
    """``df`` with the backend's value for each path of an array column."""
    @F.pandas_udf(f"array<{kind}>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict = {}

        def one(path):
            if path not in known:
                known[path] = fn(path, **params)
            return known[path]

        return lists.map(lambda ps: [] if ps is None else [one(p) for p in ps])

    return df.withColumn(name, run(F.col(column)))


def _keep(df: DataFrame, inside, any_or_all: str) -> DataFrame:
    if any_or_all not in ("any", "all"):
        raise ValueError("any_or_all is any or all")
    test = (F.exists if any_or_all == "any" else F.forall)("_values", inside)
    return df.where((F.size("_values") == 0) | test).drop("_values")


def _media_filter(name: str, column: str, params: dict, inside, kind: str = "double", default=None) -> None:
    def fn(df, ctx, p):
        own = {k: v for k, v in p.items() if k != "any_or_all"}
        found = values(df, column, need(ctx, name, default), own, kind)
        return _keep(found, inside(p), p["any_or_all"])

    fn.__doc__ = f"Rows of which any or all {column} meet the bounds; a row without {column} is kept."
    _declare(name, "filter", {**params, "any_or_all": "any"}, fn)


def _range(low: str, high: str):
    return lambda p: lambda v: (v >= float(Fraction(p[low]) if isinstance(p[low], str) else p[low])) & (v <= float(Fraction(p[high]) if isinstance(p[high], str) else p[high]))


def _below(key: str):
    return lambda p: lambda v: v < p[key]


def _sized(p):
    low, high = bytes_of(p["min_size"]), bytes_of(p["max_size"])
    return lambda v: (v >= low) & (v <= high)


def _shaped(p):
    return lambda v: v["w"].between(p["min_width"], p["max_width"]) & v["h"].between(p["min_height"], p["max_height"])


def _file_size(path: str, **_) -> float:
    return float(os.path.getsize(path))


def _shape_row(path: str, **_) -> dict:
    w, h = image_shape(path)
    return {"w": w, "h": h}


def _aspect(path: str, **_) -> float:
    w, h = image_shape(path)
    return w / h


_FRAMES = {"frame_sampling_method": "all_keyframes", "frame_num": 3}
_FLIP = {"horizontal_flip": False, "vertical_flip": False}
_WH = {"min_width": 1, "max_width": sys.maxsize, "min_height": 1, "max_height": sys.maxsize}

_media_filter("audio_duration_filter", "audios", {"min_duration": 0, "max_duration": sys.maxsize}, _range("min_duration", "max_duration"), default=wav_seconds)
_media_filter("audio_nmf_snr_filter", "audios", {"min_snr": 0, "max_snr": sys.maxsize, "nmf_iter_num": 500}, _range("min_snr", "max_snr"))
_media_filter("audio_size_filter", "audios", {"min_size": "0", "max_size": "1TB"}, _sized, default=_file_size)
_media_filter("image_aesthetics_filter", "images", {"hf_scorer_model": "", "trust_remote_code": False, "min_score": 0.5, "max_score": 1.0}, _range("min_score", "max_score"))
_media_filter("image_aspect_ratio_filter", "images", {"min_ratio": 0.333, "max_ratio": 3.0}, _range("min_ratio", "max_ratio"), default=_aspect)
_media_filter("image_face_ratio_filter", "images", {"cv_classifier": "", "min_ratio": 0.0, "max_ratio": 0.4}, _range("min_ratio", "max_ratio"))
_media_filter("image_nsfw_filter", "images", {"hf_nsfw_model": "Falconsai/nsfw_image_detection", "trust_remote_code": False, "score_threshold": 0.5}, _below("score_threshold"))
_media_filter("image_shape_filter", "images", dict(_WH), _shaped, "struct<w:int,h:int>", _shape_row)
_media_filter("image_size_filter", "images", {"min_size": "0", "max_size": "1TB"}, _sized, default=_file_size)
_media_filter("image_watermark_filter", "images", {"hf_watermark_model": "amrul-hzz/watermark_detector", "trust_remote_code": False, "prob_threshold": 0.8}, _below("prob_threshold"))
_media_filter("video_aesthetics_filter", "videos", {"hf_scorer_model": "", "trust_remote_code": False, "min_score": 0.4, "max_score": 1.0, "frame_sampling_method": "uniform", "frame_num": 3, "reduce_mode": "avg"}, _range("min_score", "max_score"))
_media_filter("video_aspect_ratio_filter", "videos", {"min_ratio": "9/21", "max_ratio": "21/9"}, _range("min_ratio", "max_ratio"))
_media_filter("video_duration_filter", "videos", {"min_duration": 0, "max_duration": sys.maxsize}, _range("min_duration", "max_duration"))
_media_filter("video_motion_score_filter", "videos", {"min_score": 0.25, "max_score": sys.float_info.max, "sampling_fps": 2, "size": None, "max_size": None, "relative": False}, _range("min_score", "max_score"))
_media_filter("video_nsfw_filter", "videos", {"hf_nsfw_model": "Falconsai/nsfw_image_detection", "trust_remote_code": False, "score_threshold": 0.5, **_FRAMES, "reduce_mode": "avg"}, _below("score_threshold"))
_media_filter("video_ocr_area_ratio_filter", "videos", {"min_area_ratio": 0, "max_area_ratio": 1.0, "frame_sample_num": 3, "languages_to_detect": ("ch_sim", "en")}, _range("min_area_ratio", "max_area_ratio"))
_media_filter("video_resolution_filter", "videos", dict(_WH), _shaped, "struct<w:int,h:int>")
_media_filter("video_watermark_filter", "videos", {"hf_watermark_model": "amrul-hzz/watermark_detector", "trust_remote_code": False, "prob_threshold": 0.8, **_FRAMES, "reduce_mode": "avg"}, _below("prob_threshold"))


def _text_media_filter(name: str, column: str, params: dict, low: str, high: str) -> None:
    def fn(df, ctx, p):
        """Rows of which any or all text chunks match their media; the backend maps (chunk, paths) to a score."""
        score = need(ctx, name)
        token = IMAGE_TOKEN if column == "images" else VIDEO_TOKEN
        own = {k: v for k, v in p.items() if k not in ("any_or_all", low, high)}

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
            def one(text, paths):
                out, paths = [], [] if paths is None else list(paths)
                for chunk in (text or "").split(CHUNK_END):
                    n = chunk.count(token)
                    if n and chunk.strip():
                        out.append(float(score(chunk.replace(token, ""), paths[:n], **own)))
                        paths = paths[n:]
                return out

            return pd.Series([one(t, x) for t, x in zip(texts, lists, strict=True)])

        return _keep(df.withColumn("_values", run(F.col(ctx.text_key), F.col(column))), _range(low, high)(p), p["any_or_all"])

    _declare(name, "filter", {**params, "any_or_all": "any"}, fn)


_text_media_filter("image_text_matching_filter", "images", {"hf_blip": "Salesforce/blip-itm-base-coco", "trust_remote_code": False, "min_score": 0.003, "max_score": 1.0, **_FLIP, "reduce_mode": "avg"}, "min_score", "max_score")
_text_media_filter("image_text_similarity_filter", "images", {"hf_clip": "openai/clip-vit-base-patch32", "trust_remote_code": False, "min_score": 0.1, "max_score": 1.0, **_FLIP, "reduce_mode": "avg"}, "min_score", "max_score")
_text_media_filter("phrase_grounding_recall_filter", "images", {"hf_owlvit": "google/owlvit-base-patch32", "trust_remote_code": False, "min_recall": 0.1, "max_recall": 1.0, **_FLIP, "reduce_mode": "avg", "iou_thr": 0.5, "large_area_ratio_thr": 0.95, "conf_thr": 0.0}, "min_recall", "max_recall")
_text_media_filter("video_frames_text_similarity_filter", "videos", {"hf_clip": "openai/clip-vit-base-patch32", "trust_remote_code": False, "min_score": 0.1, "max_score": 1.0, **_FRAMES, **_FLIP, "reduce_mode": "avg"}, "min_score", "max_score")


def _tagged(df: DataFrame, ctx: Context, p: dict) -> DataFrame:
    """Rows of which any or all videos have any or all of the tags."""
    own = {k: v for k, v in p.items() if k not in ("tags", "contain", "any_or_all")}
    found = values(df, "videos", need(ctx, "video_tagging_from_frames_filter"), own, "array<string>")
    wanted = F.array(*(F.lit(t.lower()) for t in p["tags"]))

    def inside(v):
        low = F.transform(v, F.lower)
        return F.arrays_overlap(low, wanted) if p["contain"] == "any" else F.size(F.array_except(wanted, low)) == 0

    return _keep(found, inside, p["any_or_all"])


_declare("video_tagging_from_frames_filter", "filter", {"tags": ("people",), "contain": "any", **_FRAMES, "any_or_all": "any"}, _tagged)


def _path_mapper(name: str, column: str, params: dict, many: bool = False, tag: str | None = None) -> None:
    def fn(df, ctx, p):
        if name.endswith("ffmpeg_wrapped_mapper") and p["filter_name"] is None:
            return df
        if tag:
            return values(df, column, need(ctx, name), p, "string" if "audio" in name else "array<string>", tag)
        out = values(df, column, need(ctx, name), p, "array<string>" if many else "string")
        return out.withColumn("__dj__source_file__", F.col(column)).withColumn(column, F.flatten("_values") if many else F.col("_values")).drop("_values")

    fn.__doc__ = f"Each distinct path of {column} through the backend, which writes a file and returns its path{'s' if many else ''}." if not tag else f"The backend's tags of each path of {column}."
    _declare(name, "mapper", params, fn)


_FFMPEG = {"filter_name": None, "filter_kwargs": None, "global_args": None, "capture_stderr": True, "overwrite_output": True}
_BLUR = {"cv_classifier": "", "blur_type": "gaussian", "radius": 2}
_path_mapper("audio_ffmpeg_wrapped_mapper", "audios", _FFMPEG)
_path_mapper("video_ffmpeg_wrapped_mapper", "videos", _FFMPEG)
_path_mapper("image_blur_mapper", "images", {"p": 0.2, "blur_type": "gaussian", "radius": 2})
_path_mapper("image_face_blur_mapper", "images", _BLUR)
_path_mapper("video_face_blur_mapper", "videos", _BLUR)
_path_mapper("video_remove_watermark_mapper", "videos", {"roi_strings": ("0,0,0.1,0.1",), "roi_type": "ratio", "roi_key": None, "frame_num": 10, "min_frame_threshold": 7, "detection_method": "pixel_value", "threshold": None})
_path_mapper("video_resize_aspect_ratio_mapper", "videos", {"min_ratio": "9/21", "max_ratio": "21/9", "strategy": "increase"})
_path_mapper("video_resize_resolution_mapper", "videos", {**_WH, "force_original_aspect_ratio": "disable", "force_divisible_by": 2})
_path_mapper("video_split_by_scene_mapper", "videos", {"detector": "ContentDetector", "threshold": 27.0, "min_scene_len": 15, "show_progress": False}, many=True)
_path_mapper("video_split_by_duration_mapper", "videos", {"split_duration": 10, "min_last_split_duration": 0, "keep_original_sample": True}, many=True)
_path_mapper("video_split_by_key_frame_mapper", "videos", {"keep_original_sample": True}, many=True)
_path_mapper("video_tagging_from_audio_mapper", "videos", {"hf_ast": "MIT/ast-finetuned-audioset-10-10-0.4593", "trust_remote_code": False}, tag="__dj__video_audio_tags__")
_path_mapper("video_tagging_from_frames_mapper", "videos", dict(_FRAMES), tag="__dj__video_frame_tags__")


def rescale(width: int, height: int, low: Fraction, high: Fraction, strategy: str = "increase") -> tuple[int, int]:
    """Even sizes whose ratio lies in range; one side is increased or decreased."""
    ratio = Fraction(width, height)
    if low <= ratio <= high:
        return width, height
    goal = low if ratio < low else high
    wider = ratio < low
    if (strategy == "increase") == wider:
        width = -(-height * goal.numerator // goal.denominator)
    else:
        height = width * goal.denominator // goal.numerator if strategy == "decrease" else -(-width * goal.denominator // goal.numerator)
    return width + width % 2, height + height % 2


def _text_maker(name: str, column: str, params: dict) -> None:
    def fn(df, ctx, p):
        """1 to N: after the original (if kept), one row for each text that the backend makes of (text, paths); rows without media stay alone."""
        make = need(ctx, name)
        own = {k: v for k, v in p.items() if k != "keep_original_sample"}
        keep = p.get("keep_original_sample", True)

        @F.pandas_udf("array<string>")
        def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
            def one(text, paths):
                if paths is None or not len(paths):
                    return [text]
                return [text] * keep + list(make(text, list(paths), **own))

            return pd.Series([one(t, x) for t, x in zip(texts, lists, strict=True)])

        return df.withColumn("_made", run(F.col(ctx.text_key), F.col(column))).withColumn(ctx.text_key, F.explode("_made")).drop("_made")

    _declare(name, "mapper", {**params, "keep_original_sample": True}, fn)


_CAPTION = {"trust_remote_code": False, "caption_num": 1, "keep_candidate_mode": "random_any", "prompt": None, "prompt_key": None}
_text_maker("image_captioning_mapper", "images", {"hf_img2seq": "Salesforce/blip2-opt-2.7b", **_CAPTION})
_text_maker("image_captioning_from_gpt4v_mapper", "images", {"mode": "description", "api_key": "", "max_token": 500, "temperature": 1.0, "system_prompt": "", "user_prompt": "", "user_prompt_key": None, "any_or_all": "any"})
_text_maker("image_diffusion_mapper", "images", {"hf_diffusion": "CompVis/stable-diffusion-v1-4", "trust_remote_code": False, "torch_dtype": "fp32", "revision": "main", "strength": 0.8, "guidance_scale": 7.5, "aug_num": 1, "caption_key": None, "hf_img2seq": "Salesforce/blip2-opt-2.7b"})
_text_maker("video_captioning_from_audio_mapper", "videos", {})
_text_maker("video_captioning_from_frames_mapper", "videos", {"hf_img2seq": "Salesforce/blip2-opt-2.7b", **_CAPTION, **_FRAMES, **_FLIP})
_text_maker("video_captioning_from_video_mapper", "videos", {"hf_video_blip": "kpyu/video-blip-opt-2.7b-ego4d", **_CAPTION, **_FRAMES, **_FLIP})
_text_maker("video_captioning_from_summarizer_mapper", "videos", {
    "hf_summarizer": None, "trust_remote_code": False, "consider_video_caption_from_video": True, "consider_video_caption_from_audio": True, "consider_video_caption_from_frames": True,
    "consider_video_tags_from_audio": True, "consider_video_tags_from_frames": True, "vid_cap_from_vid_args": None, "vid_cap_from_frm_args": None, "vid_tag_from_aud_args": None, "vid_tag_from_frm_args": None, "keep_tag_num": 5,
})


def _media_dedup(name: str, column: str, params: dict, empty_kept: bool) -> None:
    def fn(df, ctx, p):
        """The first row of equal media (and texts, with ``consider_text``); the default compares files, a backend may hash content."""
        found = values(df, column, need(ctx, name, file_digest), {k: v for k, v in p.items() if k == "method"}, "string")
        key = F.array_join("_values", "")
        if p.get("consider_text"):
            key = F.concat(key, text_hash(F.col(ctx.text_key)))
        own = F.concat(F.lit("row:"), F.col(ctx.id_col).cast("string"))
        return first_of(found, ctx, F.when(F.size("_values") > 0, key).otherwise(own if empty_kept else F.lit("EMPTY"))).drop("_values", "_key")

    _declare(name, "deduplicator", params, fn)


_REDIS = {"redis_host": "localhost", "redis_port": 6380}
_media_dedup("image_deduplicator", "images", {"method": "phash", "consider_text": False}, True)
_media_dedup("video_deduplicator", "videos", {"consider_text": False}, True)
_media_dedup("ray_image_deduplicator", "images", {**_REDIS, "method": "phash"}, False)
_media_dedup("ray_video_deduplicator", "videos", _REDIS, False)
