"""Rule tables: what names a finding, what is kept, what is refused. Data, joined or looked up by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats, their extensions, kinds of metadata with their sensitivity, and the names that rank findings.

#: id, extension
FORMATS = [
    ("jpeg", "jpg"), ("png", "png"), ("webp", "webp"), ("pdf", "pdf"), ("tiff", "tiff"), ("gif", "gif"), ("heif", "heic"), ("avif", "avif"),
    ("docx", "docx"), ("xlsx", "xlsx"), ("pptx", "pptx"), ("odt", "odt"), ("ods", "ods"), ("odp", "odp"), ("svg", "svg"), ("jxl", "jxl"),
    ("flac", "flac"), ("wav", "wav"), ("mp3", "mp3"), ("ogg", "ogg"), ("opus", "opus"), ("ogg-flac", "oga"), ("mp4", "mp4"), ("m4a", "m4a"),
]
#: id, sensitivity, rank
KINDS = [
    ("location", "direct", 0), ("device-identity", "direct", 0), ("personal-identity", "direct", 0), ("software-fingerprint", "incidental", 2),
    ("timestamp", "correlating", 1), ("thumbnail", "direct", 0), ("editing-history", "correlating", 1), ("document-identifier", "correlating", 1),
    ("colour-profile", "correlating", 1), ("comment", "correlating", 1), ("other", "incidental", 2),
]

_PERSON, _TIME, _TOOL, _NOTE, _DEVICE, _DOC, _PLACE, _THUMB, _COLOUR, _EDIT, _OTHER = (
    "personal-identity", "timestamp", "software-fingerprint", "comment", "device-identity", "document-identifier", "location", "thumbnail", "colour-profile", "editing-history", "other",
)

#: Exif tag -> name, kind. The Exif directory falls back to the primary names.
EXIF_PRIMARY = {
    0x000B: ("ProcessingSoftware", _TOOL), 0x010E: ("ImageDescription", _NOTE), 0x010F: ("Make", _DEVICE), 0x0110: ("Model", _DEVICE),
    0x0112: ("Orientation", _OTHER), 0x0131: ("Software", _TOOL), 0x0132: ("DateTime", _TIME), 0x013B: ("Artist", _PERSON),
    0x013C: ("HostComputer", _DEVICE), 0x02BC: ("XMLPacket (XMP)", _OTHER), 0x83BB: ("IPTC/NAA", _PERSON), 0x8649: ("PhotoshopSettings", _TOOL),
    0x8773: ("InterColorProfile", _COLOUR), 0x8298: ("Copyright", _PERSON), 0x9C9B: ("XPTitle", _NOTE), 0x9C9C: ("XPComment", _NOTE),
    0x9C9D: ("XPAuthor", _PERSON), 0x9C9E: ("XPKeywords", _NOTE), 0x9C9F: ("XPSubject", _NOTE),
}
EXIF_SUB = {
    0x9003: ("DateTimeOriginal", _TIME), 0x9004: ("DateTimeDigitized", _TIME), 0x9010: ("OffsetTime", _TIME), 0x9011: ("OffsetTimeOriginal", _TIME),
    0x9012: ("OffsetTimeDigitized", _TIME), 0x9286: ("UserComment", _NOTE), 0x927C: ("MakerNote", _DEVICE), 0xA420: ("ImageUniqueID", _DOC),
    0xA430: ("CameraOwnerName", _PERSON), 0xA431: ("BodySerialNumber", _DEVICE), 0xA433: ("LensMake", _DEVICE), 0xA434: ("LensModel", _DEVICE),
    0xA435: ("LensSerialNumber", _DEVICE),
}
EXIF_GPS = {
    0x0000: "GPSVersionID", 0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude", 0x0005: "GPSAltitudeRef",
    0x0006: "GPSAltitude", 0x0007: "GPSTimeStamp", 0x0010: "GPSImgDirectionRef", 0x0011: "GPSImgDirection", 0x001D: "GPSDateStamp",
}
#: Property names that are looked for anywhere in a packet.
XMP = {
    "dc:creator": _PERSON, "dc:title": _NOTE, "dc:description": _NOTE, "dc:subject": _NOTE, "xmp:CreatorTool": _TOOL, "xmp:CreateDate": _TIME,
    "xmp:ModifyDate": _TIME, "xmp:MetadataDate": _TIME, "xmpMM:DocumentID": _DOC, "xmpMM:InstanceID": _DOC, "xmpMM:OriginalDocumentID": _DOC,
    "xmpMM:History": _EDIT, "pdf:Producer": _TOOL, "photoshop:": _TOOL, "exif:GPS": _PLACE, "tiff:Make": _DEVICE, "tiff:Model": _DEVICE,
}
PNG_KEYWORDS = {
    "Author": _PERSON, "Copyright": _PERSON, "Creation Time": _TIME, "Software": _TOOL, "Source": _DEVICE, "Title": _NOTE, "Description": _NOTE,
    "Comment": _NOTE, "Disclaimer": _NOTE, "Warning": _NOTE, "Raw profile type exif": _DEVICE, "Raw profile type APP1": _DEVICE,
    "Raw profile type iptc": _PERSON, "Raw profile type 8bim": _TOOL, "Raw profile type icc": _COLOUR, "Raw profile type xmp": _OTHER,
    "Thumb::URI": _PERSON, "Thumb::MTime": _TIME, "date:create": _TIME, "date:modify": _TIME, "date:timestamp": _TIME,
}
GIF_APPLICATIONS = {"ICCRGBG1012": _COLOUR, "MGK8BIM0000": _TOOL, "MGKIPTC0000": _PERSON, "ImageMagick": _TOOL, "Adobe Gif": _TOOL}
#: id -> name, kind
WAV_INFO = {
    "IART": ("Artist", _PERSON), "IENG": ("Engineer", _PERSON), "ITCH": ("Technician", _PERSON), "ICMS": ("Commissioned", _PERSON), "ICOP": ("Copyright", _PERSON),
    "IARL": ("ArchivalLocation", _PLACE), "ICRD": ("CreationDate", _TIME), "IDIT": ("DigitisationTime", _TIME), "ISFT": ("Software", _TOOL),
    "ITOC": ("TableOfContents", _DOC), "ISRC": ("Source", _DOC), "ICMT": ("Comment", _NOTE), "INAM": ("Title", _NOTE), "ISBJ": ("Subject", _NOTE),
    "IKEY": ("Keywords", _NOTE), "IPRD": ("Product", _NOTE), "IGNR": ("Genre", _NOTE), "IMED": ("Medium", _NOTE),
}
#: offset, width (None: to the end), name, kind
FIXED_FIELDS = {
    "bext": [(0, 256, "Description", _NOTE), (256, 32, "Originator", _PERSON), (288, 32, "OriginatorReference", _DEVICE), (320, 10, "OriginationDate", _TIME),
             (330, 8, "OriginationTime", _TIME), (348, 64, "UMID", _DOC), (602, None, "CodingHistory", _EDIT)],
    "cart": [(4, 64, "Title", _NOTE), (68, 64, "Artist", _PERSON), (132, 64, "CutID", _DOC), (196, 64, "ClientID", _PERSON), (388, 10, "StartDate", _TIME),
             (420, 64, "ProducerAppID", _TOOL), (484, 64, "ProducerAppVersion", _TOOL), (1024, 1024, "URL", _PLACE)],
    "id3v1": [(3, 30, "Title", _NOTE), (33, 30, "Artist", _PERSON), (63, 30, "Album", _NOTE), (93, 4, "Year", _TIME), (97, 30, "Comment", _NOTE)],
}
ID3_FRAMES = {
    **dict.fromkeys("TPE1 TPE2 TPE3 TPE4 TCOM TEXT TOPE TOLY TPUB TOWN TCOP TENC".split(), _PERSON),
    **dict.fromkeys("TDRC TDEN TDOR TDRL TDTG TYER TDAT TIME TRDA".split(), _TIME),
    **dict.fromkeys("TSSE TMED TFLT".split(), _TOOL), **dict.fromkeys("APIC GEOB".split(), _THUMB),
    **dict.fromkeys("UFID MCDI TSRC PRIV".split(), _DOC), **dict.fromkeys("COMM USLT SYLT TXXX TIT1 TIT2 TIT3 TALB".split(), _NOTE), "TLOC": _PLACE,
}
ID3_FRAMES_22 = {
    **dict.fromkeys("TP1 TP2 TP3 TCM TCR TEN".split(), _PERSON), **dict.fromkeys("TYE TDA TIM".split(), _TIME), "TSS": _TOOL,
    **dict.fromkeys("PIC GEO".split(), _THUMB), **dict.fromkeys("UFI MCI TRC".split(), _DOC), **dict.fromkeys("COM ULT TXX TT1 TT2 TT3 TAL".split(), _NOTE),
}
#: Prefixes of upper-cased names, the first that matches decides.
PREFIXES = {
    "vorbis": [("ARTIST", _PERSON), ("ALBUMARTIST", _PERSON), ("PERFORMER", _PERSON), ("COMPOSER", _PERSON), ("CONDUCTOR", _PERSON), ("COPYRIGHT", _PERSON),
               ("ORGANIZATION", _PERSON), ("ENCODED-BY", _PERSON), ("CONTACT", _PERSON), ("LOCATION", _PLACE), ("GEO", _PLACE), ("GPS", _PLACE), ("DATE", _TIME),
               ("YEAR", _TIME), ("ENCODER", _TOOL), ("ENCODING", _TOOL), ("SOURCEMEDIA", _TOOL), ("MUSICBRAINZ", _DOC), ("CDDB", _DOC), ("ISRC", _DOC),
               ("REPLAYGAIN", _OTHER), ("COMMENT", _NOTE), ("DESCRIPTION", _NOTE), ("METADATA_BLOCK_PICTURE", _THUMB)],
    "ape": [("ARTIST", _PERSON), ("COMPOSER", _PERSON), ("PERFORMER", _PERSON), ("COPYRIGHT", _PERSON), ("PUBLISHER", _PERSON), ("YEAR", _TIME),
            ("RECORD DATE", _TIME), ("TOOL", _TOOL), ("ENCODER", _TOOL), ("REPLAYGAIN", _OTHER), ("ISRC", _DOC), ("CATALOG", _DOC), ("COVER ART", _THUMB), ("COMMENT", _NOTE)],
}

#: Boxes that a level of a movie's index keeps; those that are levels themselves are keys.
BOXES = {
    "moov": ("mvhd", "trak"), "trak": ("tkhd", "edts", "tref", "mdia"), "mdia": ("mdhd", "hdlr", "minf"),
    "minf": ("vmhd", "smhd", "hmhd", "sthd", "nmhd", "stbl", "dinf"),
    "stbl": ("stsd", "stts", "ctts", "cslg", "stss", "stsh", "sdtp", "stsc", "stsz", "stz2", "stco", "co64", "sbgp", "sgpd", "stps"),
}
#: Box -> why a movie that holds it is refused; sample entries that are encrypted; brand (or its beginning) -> refusal.
BOX_REFUSALS = {
    **dict.fromkeys(("moof", "mfra", "mvex", "styp", "sidx", "ssix"), "fragmented-mp4"), **dict.fromkeys(("pssh", "senc", "sinf", "schm"), "protected-media"),
}
PROTECTED_ENTRIES = ("encv", "enca", "encs", "enct", "drms", "drmi")
BRAND_REFUSALS = {
    **dict.fromkeys(("dash", "msdh", "msix", "cmfc", "cmfl"), "fragmented-mp4"), "M4P ": "protected-media", "qt  ": "quicktime-movie",
    **dict.fromkeys(("3gp", "3g2"), "third-generation-partnership"),
}
XMP_UUID = bytes.fromhex("BE7ACFCB97A942E89C71999491E3AFAC")
#: A tag atom's name after its first byte (A9, not UTF-8, is shown as a replacement character) -> kind.
MP4_ATOMS = {
    **dict.fromkeys(("\ufffdxyz", "loci", "gps ", "\ufffdgps"), _PLACE), **dict.fromkeys(("\ufffdday", "date", "\ufffddtm"), _TIME),
    **dict.fromkeys(("\ufffdtoo", "\ufffdswr", "\ufffdenc", "\ufffdreq"), _TOOL), **dict.fromkeys(("\ufffdmak", "\ufffdmod", "mak ", "mod ", "\ufffdxmk", "\ufffdxmd"), _DEVICE),
    **dict.fromkeys(("\ufffdART", "aART", "\ufffdwrt", "\ufffdalb", "\ufffdcpy", "cprt", "auth", "perf", "\ufffdprf", "\ufffdope"), _PERSON),
    **dict.fromkeys(("covr", "\ufffdart"), _THUMB), **dict.fromkeys(("\ufffdcmt", "desc", "ldes", "\ufffddes", "\ufffdlyr"), _NOTE),
}
#: Stills: boxes of a motion picture, brands of a sequence, what the index keeps, items that are pictures, properties that are kept.
MOTION_BOXES, SEQUENCE_BRANDS = ("moov", "moof", "mfra", "mvex"), ("msf1", "hevc")
STILL_META = ("hdlr", "pitm", "iloc", "iinf", "iref", "iprp", "dinf")
STILL_ITEMS = ("av01", "hvc1", "hev1", "vvc1", "unci", "jpeg", "grid", "iovl")
STILL_PROPERTIES = ("ispe", "pixi", "av1C", "hvcC", "vvcC", "pasp", "clap", "irot", "imir", "auxC", "a1op", "a1lx", "lsel", "clli", "mdcv")

#: Packages: content type of the main part, or media type, -> format; what their parts are known by.
OFFICE_MAIN = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml": "pptx",
}
OFFICE_PROPERTIES = {
    "application/vnd.openxmlformats-package.core-properties+xml": _PERSON,
    "application/vnd.openxmlformats-officedocument.extended-properties+xml": _TOOL,
    "application/vnd.openxmlformats-officedocument.custom-properties+xml": _PERSON,
}
THUMBNAIL_RELATION = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/thumbnail"
OFFICE_ELEMENTS = {
    **dict.fromkeys(("dc:creator", "cp:lastModifiedBy", "Manager", "Company"), _PERSON), **dict.fromkeys(("dcterms:created", "dcterms:modified", "cp:lastPrinted"), _TIME),
    **dict.fromkeys(("Application", "AppVersion", "Template"), _TOOL), **dict.fromkeys(("TotalTime", "cp:revision"), _EDIT),
    **dict.fromkeys(("cp:contentStatus", "dc:description", "cp:keywords", "dc:subject"), _NOTE),
}
#: Attribute, or element and attribute, -> kind.
OFFICE_ATTRIBUTES = {
    **dict.fromkeys(("w:rsidR", "w:rsidRDefault", "w:rsidP", "w:rsidRPr", "w:rsidTr", "w:rsidSect", "w:rsidDel", "w:rsidRProp"), _EDIT),
    **dict.fromkeys(("w14:paraId", "w14:textId"), _DOC), "w:author": _PERSON, "w:initials": _PERSON, "w:date": _TIME,
    "p:cmAuthor name": _PERSON, "p:cmAuthor initials": _PERSON,
}
ODF_MEDIA = {
    "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp",
}
#: Folders and parts that go whole.
ODF_FOLDERS = {"Thumbnails/": _THUMB, "Configurations2/": _TOOL}
ODF_PARTS = {"meta.xml": _PERSON, "settings.xml": _TOOL, "layout-cache": _OTHER}
ODF_ATTRIBUTION = {"dc:creator": _PERSON, "dc:date": _TIME, "meta:date-string": _TIME}
ODF_FIELDS = {
    **dict.fromkeys(("text:creator", "text:initial-creator", "text:author-name", "text:author-initials", "text:printed-by"), _PERSON),
    **dict.fromkeys(("text:editing-cycles", "text:editing-duration"), _EDIT),
}
ODF_DISPLAYED = ("creation-date", "creation-time", "modification-date", "modification-time", "print-date", "print-time")
ODF_META = {
    **dict.fromkeys(("meta:initial-creator", "dc:creator", "meta:printed-by"), _PERSON), **dict.fromkeys(("meta:creation-date", "dc:date", "meta:print-date"), _TIME),
    **dict.fromkeys(("meta:editing-cycles", "meta:editing-duration"), _EDIT), "meta:generator": _TOOL, **dict.fromkeys(("dc:title", "dc:description", "dc:subject"), _NOTE),
}
ODF_SETTINGS = {
    "PrinterName": _DEVICE, "PrinterSetup": _DEVICE, "CurrentDatabaseDataSource": _PERSON, "CurrentDatabaseCommand": _PERSON, "BuildId": _TOOL, "ColorPalettes": _TOOL,
}
#: Extra fields of an archive that tell of the machine; pictures that may be in a package; formats that are packages.
HOST_FIELDS = (0x5455, 0x000A, 0x7875, 0x5855)
EMBEDDED = ("jpeg", "png", "webp", "gif", "tiff", "heif", "avif")
PACKAGES = ("docx", "xlsx", "pptx", "odt", "ods", "odp")

# What happens to a segment: format, key -> action, kind, location. '*' is any other key of the format.
#   keep; retain: kept and declared; note: kept as an unparsed region; drop: a finding unless its items are the findings;
#   silent: dropped without one; rewrite: its replacement is kept and its items are findings; zero: rewrite, declared as retained;
#   refuse: the file is refused.
_PNG_KEPT = "IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB sBIT bKGD hIST cICP mDCV cLLI acTL fcTL fdAT".split()
RULES = [
    *[("png", k, "keep", None, None) for k in ["signature", *_PNG_KEPT]],
    ("png", "pHYs", "retain", None, "pHYs"), ("png", "tEXt", "drop", _OTHER, None), ("png", "zTXt", "drop", _OTHER, None), ("png", "iTXt", "drop", _OTHER, None),
    ("png", "tIME", "drop", _TIME, None), ("png", "eXIf", "drop", _OTHER, None), ("png", "iCCP", "drop", _COLOUR, None),
    ("png", "trailing:nested", "drop", _THUMB, "trailing data after IEND"), ("png", "trailing", "drop", _OTHER, "trailing data after IEND"),
    ("png", "*ancillary", "drop", _OTHER, None), ("png", "*", "note", None, None),
    *[("jpeg", f"APP{i}", "drop", {10: _NOTE, 12: _TOOL}.get(i, _OTHER), {3: "APP3 (Meta)", 12: "APP12 (Ducky)"}.get(i)) for i in range(16)],
    ("jpeg", "APP0:JFXX", "drop", _THUMB, "APP0 (JFXX thumbnail)"), ("jpeg", "APP0:JFIF-short", "drop", _OTHER, "APP0 (JFIF, malformed)"),
    ("jpeg", "APP0:JFIF", "retain", None, "APP0 (JFIF)"), ("jpeg", "APP0:JFIF-thumbnail", "zero", None, "APP0 (JFIF)"),
    ("jpeg", "APP1:Exif", "drop", _OTHER, "APP1 (Exif)"), ("jpeg", "APP1:XMP", "drop", _OTHER, "APP1 (XMP)"),
    ("jpeg", "APP2:ICC", "drop", _COLOUR, "APP2 (ICC profile)"), ("jpeg", "APP2:MPF", "drop", _THUMB, "APP2 (MPF)"), ("jpeg", "APP2:FPXR", "drop", _OTHER, "APP2 (FlashPix)"),
    ("jpeg", "APP13:Photoshop", "drop", _PERSON, "APP13 (Photoshop/IPTC)"), ("jpeg", "APP14:Adobe", "retain", None, "APP14 (Adobe)"),
    ("jpeg", "COM", "drop", _NOTE, "COM"), ("jpeg", "trailing:nested", "drop", _THUMB, "trailing data after EOI"),
    ("jpeg", "trailing", "drop", _OTHER, "trailing data after EOI"), ("jpeg", "*", "keep", None, None),
    ("gif", "prefix", "keep", None, None), ("gif", "image", "keep", None, None), ("gif", "trailer", "keep", None, None), ("gif", "control", "keep", None, None),
    ("gif", "control>text", "silent", None, None), ("gif", "comment", "drop", _NOTE, "Comment Extension"), ("gif", "text", "drop", _NOTE, "Plain Text Extension"),
    ("gif", "application:loop", "retain", None, "Application Extension (loop count)"), ("gif", "application:XMP", "drop", _OTHER, "Application Extension (XMP)"),
    ("gif", "application", "drop", _OTHER, "Application Extension"), ("gif", "trailing:nested", "drop", _THUMB, "trailing data after the trailer"),
    ("gif", "trailing", "drop", _OTHER, "trailing data after the trailer"), ("gif", "*", "drop", _OTHER, None),
    *[("webp", k, "keep", None, None) for k in ("VP8X", "VP8 ", "VP8L", "ALPH", "ANIM", "ANMF")],
    ("webp", "VP8X:flags", "rewrite", None, None), ("webp", "ANMF:filtered", "rewrite", None, None), ("webp", "ANMF:opaque", "note", None, "ANMF"),
    ("webp", "ICCP", "drop", _COLOUR, None), ("webp", "EXIF", "drop", _OTHER, None), ("webp", "XMP ", "drop", _OTHER, "XMP"),
    ("webp", "trailing:nested", "drop", _THUMB, "trailing data after the RIFF chunk"), ("webp", "trailing", "drop", _OTHER, "trailing data after the RIFF chunk"),
    ("webp", "*", "drop", _OTHER, None),
    *[("wav", k, "keep", None, None) for k in ("fmt ", "data", "fact", "cue ", "JUNK", "PAD ", "FLLR")],
    *[("wav", f"{k}:data", "zero", _OTHER, None) for k in ("JUNK", "PAD ", "FLLR")],
    ("wav", "LIST", "drop", _OTHER, "LIST"), ("wav", "bext", "drop", _OTHER, None), ("wav", "cart", "drop", _OTHER, None), ("wav", "_PMX", "drop", _OTHER, None),
    ("wav", "iXML", "drop", _DEVICE, None), ("wav", "id3 ", "drop", _OTHER, "id3"), ("wav", "ID3 ", "drop", _OTHER, "id3"), ("wav", "DISP", "drop", _NOTE, None),
    ("wav", "smpl", "drop", _DEVICE, None), ("wav", "trailing", "drop", _OTHER, "trailing data after the RIFF chunk"), ("wav", "*", "drop", _OTHER, None),
    ("flac", "tag", "drop", _OTHER, None), ("flac", "marker", "keep", None, None), ("flac", "STREAMINFO", "rewrite", None, None),
    ("flac", "STREAMINFO:md5", "declared", None, "STREAMINFO (MD5 of the unencoded audio)"), ("flac", "SEEKTABLE", "rewrite", None, None),
    ("flac", "PADDING", "rewrite", None, None), ("flac", "VORBIS_COMMENT", "itemised", None, None), ("flac", "APPLICATION", "drop", _TOOL, None),
    ("flac", "CUESHEET", "drop", _DOC, None), ("flac", "PICTURE", "drop", _THUMB, None), ("flac", "audio", "keep", None, None), ("flac", "*", "drop", _OTHER, None),
    ("mp3", "tag", "drop", _OTHER, None), ("mp3", "padding", "drop", _OTHER, "zero padding before the first frame"), ("mp3", "audio", "keep", None, None),
    ("mp3", "audio:Xing", "retain", None, "Xing header frame, which names the encoder"), ("mp3", "audio:Info", "retain", None, "Info header frame, which names the encoder"),
    ("mp3", "audio:VBRI", "retain", None, "VBRI header frame, which names the encoder"),
    *[("jxl", k, "keep", None, None) for k in ("codestream", "JXL ", "ftyp", "jxll", "jxlc", "jxlp")],
    ("jxl", "Exif", "drop", _OTHER, "Exif box"), ("jxl", "xml ", "drop", _OTHER, "xml box (XMP)"), ("jxl", "jumb", "drop", _EDIT, "jumb box (JUMBF, C2PA provenance)"),
    ("jxl", "brob", "drop", _OTHER, "brob box (Brotli-compressed metadata)"), ("jxl", "jbrd", "drop", _OTHER, "jbrd box (JPEG reconstruction data)"),
    ("jxl", "jxli", "drop", _OTHER, "jxli box (frame index)"), ("jxl", "free", "drop", _OTHER, "free box (padding)"), ("jxl", "skip", "drop", _OTHER, "skip box (padding)"),
    ("jxl", "*", "refuse", None, "unknown-jxl-box"),
    *[(f, "rebuilt", "rewrite", None, None) for f in ("ogg", "opus", "ogg-flac", "tiff")], ("ogg-flac", "rebuilt:md5", "zero", None, "STREAMINFO (MD5 of the unencoded audio)"),
    *[(f, k, "keep", None, None) for f in ("mp4", "m4a") for k in ("ftyp", "mdat")], *[(f, "moov", "rewrite", None, None) for f in ("mp4", "m4a")],
    *[(f, "codec", "declared", None, "moov/trak/mdia/minf/stbl/stsd (codec configuration)") for f in ("mp4", "m4a")],
    *[(f, k, "drop", _OTHER, v) for f in ("mp4", "m4a") for k, v in (("dropped", None), ("trailing", "trailing data"))],
    *[(f, "rebuilt", "rewrite", None, None) for f in ("heif", "avif")], *[(f, "colour", "declared", None, "iprp/ipco (colr nclx)") for f in ("heif", "avif")],
    ("svg", "text", "keep", None, None), ("svg", "cut", "drop", _OTHER, None), ("svg", "embedded", "rewrite", None, None), ("svg", "held", "declared", None, None),
]
#: Why a retained item stays; others would alter the payload.
REASONS = {("mp4", "codec"): "structurally-required", ("m4a", "codec"): "structurally-required", ("flac", "STREAMINFO:md5"): "derived-from-payload", ("ogg-flac", "rebuilt:md5"): "derived-from-payload", **{("wav", f"{k}:data"): "structurally-required" for k in ("JUNK", "PAD ", "FLLR")}}
#: format, key -> what the file can no longer do.
CAPABILITIES = {
    ("wav", "smpl"): ("smpl", "be looped by a sampler at the points it recorded"),
    ("flac", "CUESHEET"): ("CUESHEET", "be split into the tracks of the disc it was ripped from"),
    ("jxl", "jbrd"): ("the jbrd box (JPEG bitstream reconstruction data)", "be converted back to the original JPEG bit-for-bit"),
}
#: What is copied without a look inside.
OUT_OF_SCOPE = {
    "wav": "audio samples, which are copied without being decoded", "flac": "audio frames, which are copied without being decoded",
    "mp3": "audio frames, which are copied without being decoded", **dict.fromkeys(("ogg", "opus", "ogg-flac"), "audio packets, which are copied without being decoded"),
    **dict.fromkeys(("mp4", "m4a"), "coded samples (SEI user data and in-band codec headers are not decoded)"),
    "jxl": "a JPEG XL codestream, whose ICC profile and preview frame are coded inside the image data",
}
#: Wordings.
LABELS = {
    "location": "location", "device-identity": "device identity", "personal-identity": "personal identity", "software-fingerprint": "software fingerprint", "timestamp": "timestamp",
    "thumbnail": "embedded thumbnail", "editing-history": "editing history", "document-identifier": "document identifier", "colour-profile": "colour profile", "comment": "comment", "other": "other metadata",
}
PLAIN_LABELS = {
    "location": "Place", "device-identity": "Device", "personal-identity": "Person", "software-fingerprint": "Software", "timestamp": "Time", "thumbnail": "Preview picture",
    "editing-history": "Edits", "document-identifier": "Identifier shared by copies", "colour-profile": "Colour profile", "comment": "Comments", "other": "Other details",
}
MARKS = {"direct": "!!", "correlating": "!", "incidental": ""}
KEPT_BECAUSE = {
    "removal-would-alter-payload": "without it the content would change", "structurally-required": "the format needs it", "derived-from-payload": "anybody can compute it from the content",
}
SKIPS = {"symbolic-link": "symbolic link, not followed", "not-a-file": "not a regular file, skipped", "unreadable": "could not be read"}
#: Formats that have a walker.
WALKED = ("png", "jpeg", "gif", "webp", "wav", "flac", "mp3", "jxl", "ogg", "opus", "ogg-flac", "tiff", "svg", "mp4", "m4a", "heif", "avif")


def items() -> list[tuple[str, str, str, str]]:
    """(scope, name, label, kind): the dictionaries in one table. A scope's '*' row is for any other name, label null: the name itself."""
    out = []
    tag = "{:04X}".format
    for scope in ("IFD0", "Interop IFD"):
        out += [(scope, tag(t), n, k) for t, (n, k) in EXIF_PRIMARY.items()] + [(scope, "*", None, _OTHER)]
    out += [("Exif IFD", tag(t), n, k) for t, (n, k) in {**EXIF_PRIMARY, **EXIF_SUB}.items()] + [("Exif IFD", "*", None, _OTHER)]
    out += [("IFD1 (thumbnail)", tag(t), n, _THUMB) for t, (n, _) in EXIF_PRIMARY.items()] + [("IFD1 (thumbnail)", "*", None, _THUMB)]
    out += [("GPS IFD", tag(t), n, _PLACE) for t, n in EXIF_GPS.items()] + [("GPS IFD", "*", None, _PLACE)]
    for scope, table in (("xmp", XMP), ("png", PNG_KEYWORDS), ("gif", GIF_APPLICATIONS), ("mp4", MP4_ATOMS), ("id3", ID3_FRAMES), ("id3v22", ID3_FRAMES_22)):
        out += [(scope, n, n, k) for n, k in table.items()] + [(scope, "*", None, _OTHER)]
    out += [("info", i, n, k) for i, (n, k) in WAV_INFO.items()] + [("info", "*", None, _OTHER)]
    for scope, table in FIXED_FIELDS.items():
        out += [(scope, n, n, k) for _, _, n, k in table]
    return out


def dim_item(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(items(), "scope string, name string, label string, kind string")


def dim_rule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "format string, key string, action string, kind string, location string")


def dim_kind(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, sensitivity string, rank int")


def dim_format(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, extension string")


def prefix_kind(scope: str, name: Column) -> Column:
    """The kind of a name by its scope's prefixes, first match first."""
    upper, out = F.upper(name), None
    for prefix, kind in PREFIXES[scope]:
        hit = upper.startswith(prefix)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(_OTHER)
