"""Failures that an operator or stage reports."""


class PipelineError(Exception):
    """Base of all."""


class UnreadableMediaError(PipelineError):
    pass


class UnreadableAudioError(PipelineError):
    pass


class MissingAudioError(PipelineError):
    pass


class MissingVideoError(PipelineError):
    """Not fatal: a recording without video has no slides."""


class BackendUnavailableError(PipelineError):
    pass


class MediaProcessingError(PipelineError):
    pass


class HwaccelUnavailableError(MediaProcessingError):
    pass


class SlideExtractionError(PipelineError):
    pass


class CacheError(PipelineError):
    pass


class ConfigError(PipelineError):
    pass


class NetworkAccessDenied(PipelineError):
    pass
