"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel


class ModelNotFound(FileNotFoundError):
    """No model has been saved at the given path yet."""


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as error:
        text = str(error)
        if "PATH_NOT_FOUND" in text or "does not exist" in text:
            raise ModelNotFound(path) from error
        raise
