"""Golden rows of the string, time and file functions."""

import pytest
from pyspark.sql import functions as F

from tidelane.functions import names, text, times
from tidelane.operators import media, search
from tidelane.sources import detect, subtitles


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_times(spark):
    for shown, ms in (("00:01:02.500", 62500), ("1:02:03", 3723000), ("90.25", 90250), ("00:00:19,987", 19987), ("x", None), ("1:2:3:4", None)):
        assert one(spark, times.parse_ms(F.lit(shown))) == ms
    assert one(spark, times.format_ms(F.lit(3723004))) == "01:02:03.004"
    assert one(spark, times.format_centi(F.lit(3723015))) == "1:02:03.02"
    assert one(spark, times.rescale(F.lit(5), 2, 1)) == 2


def test_name_format(spark):
    tags = {"Name": F.lit("Pilot / Part 1"), "TV Show": F.lit("The Show: Reborn"), "TV Season": F.lit(2), "TV Episode #": F.lit(5), "Nothing": F.lit(None), "Kind": F.lit("hELLO  woRLD"), "Day": F.lit("2008-01-20")}
    for pattern, want in (
        ("{Kind|capitalize}", "Hello World"), ("{Day:yyyy}", "2008"), ("{Kind|train}", "Hello-World"),
        ("{Name}", "Pilot - Part 1"), ("{Name|upper}", "PILOT - PART 1"), ("{TV Show|snake}", "the_show_reborn"),
        ("{TV Show|dot}.S{TV Season:00}E{TV Episode #:000}", "The.Show.Reborn.S02E005"), ("{TV Show|camel}", "theShowReborn"), ("{Nothing}", None),
    ):
        assert one(spark, text.name_format(pattern, tags)) == want
    assert one(spark, text.template("{Name} {Nothing}", tags)) is None


#: Fixed values, goldens that any reader of release names must give: name, title, season, episode.
TV_NAMES = [
    ("Breaking.Bad.S01E02.720p.HDTV.x264-CTU.mkv", "Breaking Bad", 1, 2), ("breaking.bad.s1e2.mkv", "breaking bad", 1, 2), ("The Office (US) - S02E01 - The Dundies.mp4", "The Office (US)", 2, 1),
    ("Game of Thrones S08E06 1080p WEB H264-MEMENTO.mkv", "Game of Thrones", 8, 6), ("game_of_thrones_s03e09_the_rains_of_castamere.mkv", "game of thrones", 3, 9), ("Lost.1x02.Pilot.Part.2.avi", "Lost", 1, 2), ("Lost 1x02.avi", "Lost", 1, 2),
    ("Friends - 10x17-18 - The Last One.avi", "Friends", 10, 17), ("Twin Peaks Season 2 Episode 7.mkv", "Twin Peaks", 2, 7), ("Twin.Peaks.Season.2.Episode.7.mkv", "Twin Peaks", 2, 7), ("Twin Peaks - Season 2 - Episode 07.mkv", "Twin Peaks", 2, 7),
    ("The.Expanse.S02.E03.1080p.mkv", "The Expanse", 2, 3), ("The Expanse S02 E03.mkv", "The Expanse", 2, 3), ("Sherlock.S01E01E02.mkv", "Sherlock", 1, 1), ("Sherlock.S01E01-E02.mkv", "Sherlock", 1, 1), ("Sherlock.S01E01-02.mkv", "Sherlock", 1, 1),
    ("Doctor.Who.2005.S10E01.The.Pilot.mkv", "Doctor Who", 10, 1), ("Doctor Who (2005) - S10E01.mkv", "Doctor Who", 10, 1), ("Marvels.Agents.of.S.H.I.E.L.D.S05E01.720p.mkv", "Marvels Agents of S.H.I.E.L.D.", 5, 1),
    ("Star Trek - The Next Generation - S03E15 - Yesterday's Enterprise.mkv", "Star Trek - The Next Generation", 3, 15), ("The.Simpsons.S35E100.mkv", "The Simpsons", 35, 100), ("one_piece_s01e1071.mkv", "one piece", 1, 1071), ("Mr. Robot S04E13.mkv", "Mr. Robot", 4, 13),
    ("[Group] Breaking Bad S01E02 [720p].mkv", "Breaking Bad", 1, 2), ("24.S01E01.12.00.A.M.-1.00.A.M.DVDRip.avi", "24", 1, 1), ("Shogun.2024.S01E01.Anjin.2160p.DSNP.WEB-DL.DDP5.1.H.265-NTb.mkv", "Shogun", 1, 1),
    ("[HorribleSubs] One Punch Man - 05 [1080p].mkv", "One Punch Man", 1, 5), ("[SubsPlease] Frieren - 12 (1080p) [ABCD1234].mkv", "Frieren", 1, 12), ("[Erai-raws] Kimetsu no Yaiba - 03v2 [720p][Multiple Subtitle].mkv", "Kimetsu no Yaiba", 1, 3),
    ("[Group] Shingeki no Kyojin S3 - 01 [BD 1080p].mkv", "Shingeki no Kyojin", 3, 1), ("[Judas] Cowboy Bebop - 026 [1080p][HEVC x265 10bit].mkv", "Cowboy Bebop", 1, 26),
    ("/media/TV/Breaking Bad/Season 1/S01E02.mkv", "Breaking Bad", 1, 2), ("/media/TV/Doctor Who (2005)/Season 10/S10E01 - The Pilot.mkv", "Doctor Who", 10, 1), ("/media/TV/The Wire/S02/1x02.mkv", "The Wire", 1, 2),
]
#: Name, title, year.
MOVIE_NAMES = [
    ("The Matrix (1999).mkv", "The Matrix", 1999), ("The.Matrix.1999.1080p.BluRay.x264-GROUP.mkv", "The Matrix", 1999), ("Inception.2010.720p.BRRip.XviD.AC3-ViSiON.avi", "Inception", 2010), ("Blade_Runner_2049_2017_2160p_UHD_BluRay_x265.mkv", "Blade Runner 2049", 2017),
    ("2001.A.Space.Odyssey.1968.Remastered.1080p.mkv", "2001 A Space Odyssey", 1968), ("1917 (2019) [1080p].mp4", "1917", 2019), ("Alien [1979] Director's Cut.mkv", "Alien", 1979), ("Amélie.2001.FRENCH.1080p.mkv", "Amélie", 2001),
    ("Spider-Man.Into.the.Spider-Verse.2018.WEB-DL.mkv", "Spider-Man Into the Spider-Verse", 2018), ("Mad Max Fury Road 2015.mp4", "Mad Max Fury Road", 2015), ("Dune.Part.Two.2024.2160p.WEB-DL.DDP5.1.Atmos.DV.HDR.H.265-FLUX.mkv", "Dune Part Two", 2024),
    ("Pulp.Fiction.1080p.BluRay.x264.mkv", "Pulp Fiction", None), ("Casablanca.mkv", "Casablanca", None), ("Some Home Video", "Some Home Video", None), ("Ocean's.Eleven.2001.DVDRip.avi", "Ocean's Eleven", 2001), ("Star Wars Episode IV - A New Hope (1977).mkv", "Star Wars Episode IV - A New Hope", 1977),
]
#: Name, title, air date.
DAILY_NAMES = [("The.Daily.Show.2024.03.05.Guest.Name.720p.WEB.h264.mkv", "The Daily Show", "2024-03-05"), ("Last Week Tonight with John Oliver 2023-11-12.mkv", "Last Week Tonight with John Oliver", "2023-11-12"), ("Jeopardy_2019_01_31.mp4", "Jeopardy", "2019-01-31")]


def parsed(spark, given):
    return {r.input: r for r in names.parse_names(spark.createDataFrame([(x,) for x in given], "input string"), "input", 2026).collect()}


def test_release_names(spark):
    tv = parsed(spark, [x[0] for x in TV_NAMES])
    assert [(x[0], tv[x[0]].title, tv[x[0]].season, tv[x[0]].episode, tv[x[0]].kind) for x in TV_NAMES] == [(*x, "tv") for x in TV_NAMES]
    movies = parsed(spark, [x[0] for x in MOVIE_NAMES])
    assert [(x[0], movies[x[0]].title, movies[x[0]].year, movies[x[0]].kind, movies[x[0]].season) for x in MOVIE_NAMES] == [(*x, "movie", None) for x in MOVIE_NAMES]
    daily = parsed(spark, [x[0] for x in DAILY_NAMES])
    assert [(x[0], daily[x[0]].title, daily[x[0]].air_date, daily[x[0]].kind, str(daily[x[0]].year)) for x in DAILY_NAMES] == [(*x, "tv", x[2][:4]) for x in DAILY_NAMES]


def test_release_names_of_our_own(spark):
    got = parsed(spark, ["Sherlock.S01E01E02.mkv", "Show.S02E01-E02-E03.mkv", "Show.S02E05.mkv", "Tide 3x04-3x06.mkv", "[Tide] Low Water - 05 - 06.mkv", "Tide.Tables.1999.1080p.x264-LANE.mkv", "Low.Water.2031.mkv", "A.2019.02.31.mkv", "", "Tide Episode 9.mkv", "Room.2015.S01E03.mkv"])
    assert [got[x].last_episode for x in list(got)[:5]] == [2, 3, None, 6, 6]
    assert got["Tide.Tables.1999.1080p.x264-LANE.mkv"].release_group == "LANE" and got["Low.Water.2031.mkv"].year is None
    assert got["A.2019.02.31.mkv"].kind == "movie" and got[""].title == "" and got["Tide Episode 9.mkv"][1:5] == ("tv", "Tide", None, None)
    assert (got["Room.2015.S01E03.mkv"].title, got["Room.2015.S01E03.mkv"].year) == ("Room", 2015)


def test_titles_and_html(spark):
    assert one(spark, text.normal_title(F.lit("Amélie & Co.!"))) == "amelie and co"
    assert one(spark, text.normal_title(F.lit("Война и мир: Æon №5, Ελλάδα—ŁÓDŹ"))) == "воина и мир æon 5 ελλαδα łodz"
    assert one(spark, text.same_title(F.lit("Война и мир"), F.lit("Другая книга"))) is False
    assert one(spark, text.same_title(F.lit("The Office"), F.lit("office"))) is True
    assert one(spark, text.same_title(F.lit(""), F.lit(""))) is False
    assert one(spark, text.strip_html(F.lit("<p>a&amp;b<br/>c</p>"))) == "a&b\nc"
    assert one(spark, text.redact(F.lit("http://x/?api_key=abc&q=1"))) == "http://x/?api_key=***&q=1"
    for suffix, tag in ((".de", "de"), (".forced.ENG", "en"), ("_French-sdh", "fr"), (".xx.1", None), ("", None)):
        assert one(spark, text.language_from_name(F.lit(suffix))) == tag


def test_ocr_cleaning(spark):
    for raw, want in (
        (None, ""), ("  \n ", ""), (" a \t b \r\n\n c ", "a b\nc"), (".\nHi\n-", "Hi"), ("-- ok", "-- ok"), ("l am", "I am"), ("l'm l'll l'eau", "I'm I'll l'eau"), ("heIlo MacIntyre", "hello MacIntyre"),
        ("lT'S", "IT'S"), ("1|2 \u201cx\u201d it\u2019s", '1I2 "x" it\'s'), ("J Take on me I", "\u266a Take on me \u266a"), ("f La la\nla la J", "\u266a La la\nla la \u266a"), ("J Jones", "J Jones"), ("A plan B", "A plan B"), ("J x", "J x"),
    ):
        assert one(spark, text.clean_ocr(F.lit(raw))) == want


def test_resolution(spark):
    for w, h, want in ((720, 480, 0), (960, 720, 1), (1280, 536, 1), (1280, 720, 1), (1280, 721, 2), (1920, 1088, 2), (1920, 1090, 2)):
        assert one(spark, text.hd_class(F.lit(w), F.lit(h))) == want
    assert one(spark, text.hd_class(F.lit(3840), F.lit(2160), detect_4k=True)) == 3
    assert one(spark, text.hd_class(F.lit(1920), F.lit(1090), detect_4k=True)) == 3


def test_srt_vtt_ass_and_back(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHi\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n"
    cues = subtitles.parse_srt(spark.createDataFrame([("a", srt)], "path string, text string"))
    assert [tuple(r) for r in cues.orderBy("seq").select("start_ms", "end_ms", "text").collect()] == [(1000, 2500, "Hi\nthere"), (3000, 4000, "Bye")]
    assert subtitles.to_srt(cues).first().text == srt
    vtt = subtitles.parse_vtt(subtitles.to_vtt(cues))
    assert [r.text for r in vtt.orderBy("seq").collect()] == ["Hi\nthere", "Bye"]
    ass = subtitles.parse_ass(subtitles.to_ass(cues))
    assert [tuple(r) for r in ass.orderBy("seq").select("start_ms", "text").collect()] == [(1000, "Hi\nthere"), (3000, "Bye")]


def test_chapters(spark):
    ogg = "CHAPTER01=00:00:00.000\nCHAPTER01NAME=Start\nCHAPTER02=00:01:00.000\nCHAPTER02NAME=Main = part\nCHAPTER03=00:02:00.000\n"
    plain = "00:00:00.000 Intro\n00:05:00.000\n"
    files = spark.createDataFrame([("a", ogg), ("b", plain)], "path string, text string")
    got = subtitles.parse_chapters(files)
    assert [tuple(r) for r in got.orderBy("path", "seq").select("path", "start_ms", "title").collect()] == [("a", 0, "Start"), ("a", 60000, "Main = part"), ("a", 120000, "Chapter 3"), ("b", 0, "Intro"), ("b", 300000, "Chapter 2")]
    again = subtitles.parse_chapters(subtitles.to_chapter_text(got))
    assert again.orderBy("path", "seq").collect() == got.orderBy("path", "seq").collect()


def test_detection(spark, tmp_path):
    (tmp_path / "x.mkv").write_bytes(bytes.fromhex("1A45DFA3") + b"0" * 10)
    (tmp_path / "y.mkv").write_bytes(b"\0\0\0\x18ftypisom")
    (tmp_path / "z.srt").write_bytes(b"nothing")
    (tmp_path / "w.bin").write_bytes(b"nothing")
    got = detect.detect_sources(detect.scan_heads(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: (r.container, r.score) for r in got.collect()} == {"x.mkv": ("matroska", 100), "y.mkv": ("mp4", 100), "z.srt": ("srt", 50), "w.bin": (None, 0)}


def test_text_decoding(spark):
    for raw, want in (("é".encode(), "é"), (b"\xe9", "é"), ("é".encode("utf-16"), "é"), (b"\xef\xbb\xbfa\r\nb", "a\nb")):
        assert one(spark, subtitles.decode_text(F.lit(bytearray(raw)))) == want


def test_nfo(spark):
    from tidelane.sources import nfo

    xml = "<?xml version='1.0'?>\n<episodedetails><title>Pilot</title><season>1</season><episode>2</episode><director>A</director><director>B</director><actor><name>C</name><role>D</role></actor></episodedetails>\nhttp://x/"
    got = nfo.parse_nfo(spark.createDataFrame([("a", xml), ("b", "no xml")], "path string, text string")).orderBy("path").collect()
    assert (got[0].title, got[0].season, got[0].director, got[0].actor[0].role) == ("Pilot", 1, ["A", "B"], "D") and got[1].title is None
    where = nfo.nfo_candidates(spark.createDataFrame([("/tv/Show/S1/e1.mkv",)], "path string")).orderBy("ord")
    assert [r.nfo for r in where.collect()] == ["/tv/Show/S1/e1.nfo", "/tv/Show/S1/movie.nfo", "/tv/Show/S1/tvshow.nfo", "/tv/Show/tvshow.nfo"]
    e = spark.createDataFrame([("s", "Pilot", None)], "show string, title string, plot string")
    s = spark.createDataFrame([("s", "Show", "Plot")], "show string, title string, plot string")
    assert tuple(nfo.fill_from_show(e, s, "show").first()) == ("s", "Pilot", "Plot")
    back = spark.range(1).select(F.lit("a").alias("path"), nfo.to_nfo({"title": F.lit("T & U"), "season": F.lit(3)}).alias("text"))
    assert nfo.parse_nfo(back).select("title", "season").first() == ("T & U", 3)


@pytest.mark.parametrize("n", [3, 102, 1001])
def test_chapters_beyond_two_digits_round_trip(spark, n):
    """Chapters in any order, numbered by start; hours of two digits and more."""
    rows = [("f", (i * 37) % n, i * 450_000 + 7, f"Title {i}") for i in range(n)]
    text = subtitles.to_chapter_text(spark.createDataFrame(rows, "path string, seq long, start_ms long, title string"))
    got = subtitles.parse_chapters(text).orderBy("seq").collect()
    assert [(r.path, r.seq, r.start_ms, r.title) for r in got] == [("f", i + 1, i * 450_000 + 7, f"Title {i}") for i in range(n)]
    lines = text.first().text.splitlines()
    assert lines[:2] == ["CHAPTER01=00:00:00.007", "CHAPTER01NAME=Title 0"] and lines[-1] == f"CHAPTER{n:02d}NAME=Title {n - 1}"


def test_lookups_are_equality_joins_and_keep_all_rows(spark):
    """No nested loops in the plans; an empty dimension loses no row; the first of several entries wins."""
    rows = spark.createDataFrame([(1, "143441"), (2, "uk"), (3, "germany"), (4, "Atlantis"), (5, None)], "k int, asked string")
    stores = spark.createDataFrame([(143441, "US", "United States"), (143444, "GB", "United Kingdom"), (143443, "DE", "Germany"), (9, "de", "Germania")], "id int, iso string, name string")
    found = search.find_storefront(rows, stores, "asked")
    assert sorted((r.k, r.iso) for r in found.collect()) == [(1, "US"), (2, "GB"), (3, "DE"), (4, "US"), (5, "US")]
    assert {(r.k, r.iso) for r in search.find_storefront(rows, stores.limit(0), "asked").collect()} == {(k, None) for k in range(1, 6)}
    kinds = spark.createDataFrame([(*r[:4], r[3], r[4], i) for i, r in enumerate([*media.RATINGS, ("any", "*", "movie", "none", -1)])], "system string, country string, media string, code string, name string, value int, ord int")
    asked = spark.createDataFrame([(1, "PG-13", None, "movie"), (2, "FSK 16", "DE", "tv"), (3, "unrated", "FR", "movie"), (4, None, "US", "movie"), (5, "tv14", "US", "tv"), (6, "12a", "GB", "tv")], "k int, certification string, country string, media string")
    rated = media.lookup_ratings(asked, kinds)
    assert sorted((r.k, r.r_system, r.r_code) for r in rated.collect()) == [(1, "mpaa", "PG-13"), (2, "de-tv", "Ab 16 Jahren"), (3, "any", "none"), (4, None, None), (5, "us-tv", "TV-14"), (6, "uk-movie", "12A")]
    assert media.lookup_ratings(asked, kinds.limit(0)).count() == 6
    for df in (found, rated):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
