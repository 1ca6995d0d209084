"""Column schemas of the engine's records. Times are seconds from a recording's start; order is a column, never a row's place."""

from pyspark.sql import types as T

RECT = "struct<x:int,y:int,width:int,height:int>"
WORDS = "recording_id string, pos bigint, text string, start_s double, end_s double, confidence double"
SLIDES = f"recording_id string, slide_index int, start_s double, end_s double, region {RECT}, representative_s double, image_path string"
FRAGMENTS = f"recording_id string, slide_index int, pos int, text string, kind string, confidence double, bbox {RECT}, low_confidence boolean"
SLIDE_OCR = "recording_id string, slide_index int, image_path string, markdown string, unreliable boolean, backend string"
SPEECH = "recording_id string, start_s double, end_s double"
SECTIONS = "recording_id string, section_pos int, start_s double, end_s double, slide_index int"
FRAMES = "recording_id string, idx int, ts double, path string"
LAYOUT = f"recording_id string, start_s double, end_s double, region {RECT}"
GLOSSARY = "recording_id string, rank int, term string"
MEDIA = (
    "recording_id string, path string, duration_s double,"
    " audio_tracks array<struct<index:int,codec:string,sample_rate:int,channels:int,language:string,title:string>>,"
    " video struct<index:int,codec:string,width:int,height:int,fps:double>"
)
AUDIO_BLOCKS = "recording_id string, block bigint, samples array<float>"
TRANSCRIPTS = "recording_id string, markdown string, metadata map<string,string>"


def of(ddl: str) -> T.StructType:
    """A DDL string as a StructType."""
    return T._parse_datatype_string(ddl)
