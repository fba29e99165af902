import datetime
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tramline.api import Timetable
from tramline.operators import journeys
from tramline.sources import bundle, fixed_width, folders, gtfs, messages, xml_timetable

FEED = """
# agency.txt
agency_id,agency_name,agency_url,agency_timezone
X,Xpress,http://x.example,Europe/Berlin
# stops.txt
stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,wheelchair_boarding
A,Alpha,50.0,8.0,,,
B,Beta,50.1,8.1,,,2
C,Gamma,95.0,8.2,,,
N,Node,50.0,8.0,2,,
# routes.txt
route_id,agency_id,route_short_name,route_type,route_color,route_text_color
R1,X,1,3,FF0000,FE0000
R2,X,2,2,,FFFFFF
# calendar.txt
service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date
S,1,1,1,1,1,0,0,20240101,20240131
# calendar_dates.txt
service_id,date,exception_type
S,20240103,2
S,20240106,1
S,20240103,2
# trips.txt
route_id,service_id,trip_id,trip_headsign,bikes_allowed
R1,S,T1,Beta,1
R2,S,T2,Gamma,
R9,S,T9,Nowhere,
# stop_times.txt
trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type
T1,08:30:00,08:30:00,C,30,
T1,08:00:00,08:00:00,A,10,0
T1,,,B,20,1
T2,08:35:00,08:35:00,C,1,
T2,25:05:00,25:05:00,A,2,
# transfers.txt
from_stop_id,to_stop_id,transfer_type,min_transfer_time,from_trip_id,to_trip_id
A,A,2,300,,
A,B,2,240,,
A,B,2,60,,
B,C,3,60,,
A,A,4,,T1,T2
# frequencies.txt
trip_id,start_time,end_time,headway_secs
T1,08:00:00,09:00:00,610
# translations.txt
table_name,field_name,language,translation,record_id,field_value
stops,stop_name,fr,Alphe,A,
stops,stop_name,de,Betta,,Beta
# shapes.txt
shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence
P,50.1,8.1,2
P,50.0,8.0,1
# fare_products.txt
fare_product_id,amount,currency
F,2.50,EUR
# locations.geojson
{"type": "FeatureCollection", "features": [{"id": "area", "type": "Feature", "properties": {"stop_name": "Flex"}, "geometry": {"type": "Polygon", "coordinates": [[[7.9, 49.9], [8.05, 49.9], [8.05, 50.05], [7.9, 50.05], [7.9, 49.9]]]}}]}
"""


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    return folders.from_text(FEED, str(tmp_path_factory.mktemp("feed")))


@pytest.fixture(scope="module")
def tables(spark, feed):
    return gtfs.read(spark, feed, "2024-01-01", "2024-01-07")


def test_format_is_recognised(feed, tmp_path):
    assert folders.kind_of(feed) == "gtfs"
    with pytest.raises(ValueError, match="no timetable format"):
        folders.kind_of(str(tmp_path))


def test_calendar_and_exceptions(tables):
    assert sorted(str(r.day) for r in tables["service_days"].collect()) == ["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05", "2024-01-06"]


def test_stops_and_transfers(tables):
    stops = {r.stop_id: r for r in tables["stops"].collect()}
    assert sorted(stops) == ["A", "B", "C"] and stops["C"].lat == 90.0 and stops["A"].transfer_min == 5 and stops["B"].transfer_min == 2
    assert not stops["B"].wheelchair
    assert [(r.from_id, r.to_id, r.minutes) for r in tables["footpaths"].collect()] == [("A", "B", 4)]
    assert [(r.from_trip, r.to_trip) for r in tables["seated"].collect()] == [("T1", "T2")]


def test_routes_have_readable_colours(tables):
    rows = {r.route_id: r for r in tables["routes"].collect()}
    assert rows["R1"].clasz == 10 and rows["R1"].text_color in (0xFF000000, 0xFFFFFFFF) and rows["R2"].color == 0xFF000000


def test_stop_times_are_sorted_and_filled(tables):
    rows = [(r.stop_seq, r.stop_id, r.arr, r.dep, r.in_allowed) for r in tables["stop_times"].where("trip_id = 'T1'").orderBy("stop_seq").collect()]
    assert rows == [(0, "A", 480, 480, True), (1, "B", 495, 495, False), (2, "C", 510, 510, True)]
    assert tables["stop_times"].where("trip_id = 'T2'").agg(F.max("arr")).first()[0] == 25 * 60 + 5
    assert [r.headway for r in tables["frequencies"].collect()] == [10]


def test_rejects_and_small_tables(spark, feed, tables):
    assert [r.trip_id for r in gtfs.rejected_trips(spark, feed, tables["trips"]).collect()] == ["T9"]
    assert tables["fare_products"].first().amount == "2.50" and tables["timeframes"].count() == 0
    assert [p.sequence for p in tables["shapes"].collect()] == [2, 1]
    names = gtfs.translated(tables["stops"], tables["translations"], "stops", "stop_name", "stop_id", "stop_name", "en")
    assert {r.stop_id: [t.text for t in r.texts] for r in names.collect()} == {"A": ["Alpha", "Alphe"], "B": ["Beta", "Betta"], "C": ["Gamma"]}


def test_areas_hold_stops(tables):
    from tramline.operators.areas import inside

    own = tables["stops"].withColumnRenamed("stop_id", "location_id")
    assert [(r.area_id, r.location_id) for r in inside(own, tables["areas"]).collect()] == [("area", "A")]


def test_facade_searches_and_saves(spark, feed, tmp_path):
    tt = Timetable.load(spark, feed, hooks={"stops": lambda df: df.withColumn("stop_name", F.upper("stop_name"))}, first="2024-01-01", last="2024-01-07")
    assert [r.stop_name for r in tt.stations("ALPHA").collect()] == ["ALPHA"]
    assert tt.is_active("T1", "2024-01-02") and not tt.is_active("T1", "2024-01-03")
    events = tt.on_days("2024-01-01", "2024-01-02", "Europe/Berlin")
    found = journeys.rounds(tt.search(events), spark.createDataFrame([(0, "A", 400)], "query_id long, location_id string, time long"), 2)
    best = {r.location_id: r.arr for r in journeys.one_to_all(found).collect()}
    assert best == {"B": 435, "C": 450}
    tt.save(str(tmp_path / "out"))
    assert Timetable.open(spark, str(tmp_path / "out")).counts()["stops"] == 3


def test_zips_within_zips(spark, feed, tmp_path):
    inner, outer = tmp_path / "inner.zip", tmp_path / "outer.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.write(f"{feed}/stops.txt", "stops.txt")
    with zipfile.ZipFile(outer, "w") as z:
        z.write(inner, "inner.zip")
    assert gtfs.stops(spark, folders.unpacked(spark, str(outer)) + "/inner").count() == 3
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="outside"):
        folders.unpacked(spark, str(outer))
    assert folders.gunzip(gzip.compress(b"x")) == b"x"


def test_opening_hours(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,lat,lng,time\nHelp,50.0,8.0,"Mo-We 08:00-12:00; Sa,Su 10:00-11:30"\n')
    rows = sorted((r.day, r.begin, r.end) for r in gtfs.assistance(spark, str(tmp_path / "a.csv")).collect())
    assert rows == [(0, 480, 720), (1, 480, 720), (2, 480, 720), (5, 600, 690), (6, 600, 690)]


HRD = {
    "stamm/bahnhof.101": "0000001     Aa\n0000002     Bb$<1>\n0000003     Cc\n",
    "stamm/eckdaten.101": "28.03.2020\n30.03.2020\nPlan$x\n",
    "stamm/bitfeld.101": "000001 FE\n000002 D6\n",
    "stamm/zugart_int.101": "ICE 0 A 0 ICE 0 N\nRE  3 A 0 RE 0 N\n",
    "stamm/metabhf.101": "0000001 0000002 005\n",
    "fahrten/x.101": "*Z 01337 80____       002 030                             %\n*A VE 0000001 0000003 000000                              %\n*G RE  0000001 0000003                                    %\n0000001 Aa                           00230                %\n0000002 Bb                    00330  00331                %\n0000003 Cc                    00430                       %\n*Z 00001 80____                                           %\n*A VE 0000001 0000002 000002                              %\n*A VE 0000002 0000003 000000                              %\n0000001 Aa                           00800                %\n0000002 Bb                    00810 -00811                %\n0000003 Cc                    00820                       %\n",
}


def test_fixed_width_services(spark, tmp_path):
    for name, text in HRD.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="iso-8859-1")
    assert folders.kind_of(str(tmp_path)) == "hrd"
    t = fixed_width.read(spark, str(tmp_path))
    assert sorted((r.eva, r.name) for r in t["stops"].collect()) == [("0000001", "Aa"), ("0000002", "Bb"), ("0000003", "Cc")]
    first = t["stop_events"].where("service = 'x.101#1'")
    assert first.select("trip_id").distinct().count() == 3
    assert sorted((r.arr, r.dep) for r in first.where("trip_id like '%/1'").collect()) == [(180, 180), (240, 241), (300, 300)]
    assert t["service_days"].where("trip_id like 'x.101#1%'").count() == 9
    days = {(r.trip_id, str(r.day)) for r in t["service_days"].where("trip_id like 'x.101#2%'").collect()}
    assert days == {("x.101#2/0/2/0", "2020-03-29"), ("x.101#2/1/2/0", "2020-03-28"), ("x.101#2/1/2/0", "2020-03-30")}
    assert t["footpaths"].first().minutes == 5 and {r.category: r.clasz for r in t["categories"].collect()} == {"ICE": 1, "RE": 5}
    assert not t["stop_events"].where("service = 'x.101#2' and eva = '0000002'").first().in_allowed


NETEX = """<PublicationDelivery xmlns="http://www.netex.org.uk/netex"><dataObjects>
<StopPlace id="SP1"><Name>One</Name><Centroid><Location><Longitude>8.0</Longitude><Latitude>50.0</Latitude></Location></Centroid><quays><Quay id="Q1"><Name>One a</Name></Quay></quays></StopPlace>
<PassengerStopAssignment id="a1"><ScheduledStopPointRef ref="P1"/><StopPlaceRef ref="SP1"/><QuayRef ref="Q1"/></PassengerStopAssignment>
<PassengerStopAssignment id="a2"><ScheduledStopPointRef ref="P2"/><StopPlaceRef ref="SP2"/></PassengerStopAssignment>
<Operator id="O"><Name>Op</Name></Operator>
<Line id="L"><Name>Line</Name><PublicCode>7</PublicCode><TransportMode>rail</TransportMode><TransportSubmode><RailSubmode>highSpeedRail</RailSubmode></TransportSubmode><OperatorRef ref="O"/></Line>
<ServiceJourneyPattern id="JP"><RouteView><LineRef ref="L"/></RouteView><pointsInSequence><StopPointInJourneyPattern id="X1" order="1"><ScheduledStopPointRef ref="P1"/></StopPointInJourneyPattern><StopPointInJourneyPattern id="X2" order="2"><ScheduledStopPointRef ref="P2"/><ForBoarding>false</ForBoarding></StopPointInJourneyPattern></pointsInSequence></ServiceJourneyPattern>
<UicOperatingPeriod id="UP"><FromDate>2024-03-30T00:00:00</FromDate><ToDate>2024-04-01T00:00:00</ToDate><ValidDayBits>101</ValidDayBits></UicOperatingPeriod>
<DayTypeAssignment id="d"><OperatingPeriodRef ref="UP"/><DayTypeRef ref="DT"/></DayTypeAssignment>
<ServiceJourney id="J1"><dayTypes><DayTypeRef ref="DT"/></dayTypes><ServiceJourneyPatternRef ref="JP"/><passingTimes><TimetabledPassingTime><StopPointInJourneyPatternRef ref="X1"/><DepartureTime>23:50:00</DepartureTime></TimetabledPassingTime><TimetabledPassingTime><StopPointInJourneyPatternRef ref="X2"/><ArrivalTime>00:20:00</ArrivalTime><ArrivalDayOffset>1</ArrivalDayOffset></TimetabledPassingTime></passingTimes></ServiceJourney>
<ServiceJourney id="J2"><LineRef ref="L"/><calls><Call order="1"><ScheduledStopPointRef ref="P2"/><Departure><Time>08:00:00</Time></Departure></Call><Call order="2"><ScheduledStopPointRef ref="P1"/><Arrival><Time>08:30:00</Time></Arrival></Call></calls></ServiceJourney>
<ServiceJourneyInterchange id="I"><StaySeated>true</StaySeated><FromJourneyRef ref="J1"/><ToJourneyRef ref="J2"/></ServiceJourneyInterchange>
</dataObjects></PublicationDelivery>"""


def test_xml_timetable(spark, tmp_path):
    (tmp_path / "line.xml").write_text(NETEX)
    t = folders.load(spark, str(tmp_path))
    assert {r.stop_id: r.parent_id for r in t["stops"].collect()} == {"SP1": None, "Q1": "SP1"}
    route = t["routes"].first()
    assert (route.name, route.operator_id, route.route_type, route.clasz) == ("7", "O", 101, 1)
    rows = {(r.trip_id, r.stop_seq): (r.stop_id, r.arr, r.in_allowed) for r in t["stop_events"].collect()}
    assert rows == {("J1", 0): ("Q1", 1430, True), ("J1", 1): ("SP2", 1460, False), ("J2", 0): ("SP2", 480, True), ("J2", 1): ("Q1", 510, True)}
    assert sorted(str(r.day) for r in t["day_types"].collect()) == ["2024-03-30", "2024-04-01"]
    assert {r.trip_id: r.route_id for r in t["trips"].collect()} == {"J1": "L", "J2": "L"} and t["seated"].count() == 1
    day = spark.createDataFrame([("J1", datetime.date(2024, 3, 30))], "trip_id string, day date")
    utc = {r.stop_seq: str(r.utc_arr) for r in xml_timetable.to_utc(t["stop_events"], day, "Europe/Berlin").collect()}
    assert utc == {0: "2024-03-30 22:50:00", 1: "2024-03-30 23:20:00"}


MESSAGE = {"header": {"timestamp": 1704100000}, "entity": [
    {"id": "1", "trip_update": {"trip": {"trip_id": "T1", "start_date": "20240101"}, "stop_time_update": [{"stop_sequence": 1, "arrival": {"delay": -120}}, {"stop_id": "B", "schedule_relationship": "SKIPPED"}]}},
    {"id": "2", "trip_update": {"trip": {"trip_id": "T2", "schedule_relationship": "CANCELED"}}},
    {"id": "3", "vehicle": {"trip": {"trip_id": "T1"}, "position": {"latitude": 50.0, "longitude": 8.5}, "timestamp": 1704100060}},
    {"id": "4", "alert": {"active_period": [{"start": 60, "end": 120}], "informed_entity": [{"route_id": "R"}, {"stop_id": "B", "agency_id": "X"}]}},
]}


def test_binary_messages(spark):
    data = messages.encode(MESSAGE)
    assert messages.decode(data) == MESSAGE
    df = messages.binary_to_json(spark.createDataFrame([(bytearray(data),), (bytearray(b"\xff\xff"),), (None,)], "content binary"))
    assert [r.json is None for r in df.collect()] == [False, True, True]
    own = messages.entities(df)
    rows = messages.trip_updates(own).orderBy("entity_id", "position").collect()
    assert [(r.trip_id, r.stop_seq, r.stop_id, r.arr_delay, r.skipped, r.cancelled) for r in rows] == [("T1", 1, None, -120, False, False), ("T1", None, "B", None, True, False), ("T2", None, None, None, False, True)]
    assert messages.vehicles(own).first().minute == 1704100060 // 60
    assert sorted((str(r.route_id), str(r.location_id)) for r in messages.alert_selectors(own).collect()) == [("None", "B"), ("R", "None")]
    assert [(r.begin, r.end) for r in messages.alert_periods(own).collect()] == [(1, 2)]


def test_library_agrees_with_the_wire_format():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t")
    m = file.message_type.add(name="T")
    for n, (name, kind) in {1: ("trip_id", 9), 2: ("start_time", 9), 6: ("direction_id", 13)}.items():
        m.field.add(name=name, number=n, type=kind, label=1)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    own = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.T"))(trip_id="é", start_time="08:00:00", direction_id=300)
    assert messages.decode(own.SerializeToString(), messages._TRIP) == {"trip_id": "é", "start_time": "08:00:00", "direction_id": 300}
    assert messages.encode({"trip_id": "é", "start_time": "08:00:00", "direction_id": 300}, messages._TRIP) == own.SerializeToString()


def test_reports_in_xml_and_json(spark, tmp_path):
    report = {"estimatedVehicleJourney": [{"lineRef": "L", "framedVehicleJourneyRef": {"dataFrameRef": "2024-01-01", "datedVehicleJourneyRef": "T1"}, "isCompleteStopSequence": True, "estimatedCalls": {"estimatedCall": [{"stopPointRef": "A", "aimedDepartureTime": "2024-01-01T08:00:00Z", "expectedDepartureTime": "2024-01-01T08:04:00Z"}, {"stopPointRef": "B", "aimedArrivalTime": "2024-01-01T08:10:00Z", "cancellation": True}]}}]}
    (tmp_path / "et.xml").write_text("<S>" + messages.json_to_xml(json.dumps(report)) + "</S>")
    rows = messages.estimated_calls(spark.read.schema(messages.estimated_schema()).option("rowTag", "EstimatedVehicleJourney").format("xml").load(str(tmp_path / "et.xml"))).orderBy("position").collect()
    assert [(r.run_id, r.stop_id, r.complete, r.stop_cancelled) for r in rows] == [("T1", "A", True, False), ("T1", "B", True, True)] and rows[0].new_dep - rows[0].dep == 4
    (tmp_path / "ist.xml").write_text("<D><IstFahrt><FahrtRef><FahrtID><FahrtBezeichner>9</FahrtBezeichner><Betriebstag>2024-01-01</Betriebstag></FahrtID></FahrtRef><Komplettfahrt>true</Komplettfahrt><IstHalt><HaltID>A</HaltID><Abfahrtszeit>2024-01-01T08:00:00Z</Abfahrtszeit><IstAbfahrtPrognose>2024-01-01T08:02:00Z</IstAbfahrtPrognose></IstHalt></IstFahrt></D>")
    row = messages.actual_calls(spark.read.schema(messages.actual_schema()).option("rowTag", "IstFahrt").format("xml").load(str(tmp_path / "ist.xml"))).first()
    assert (row.run_id, row.stop_id, row.new_dep - row.dep, row.complete) == ("9#2024-01-01", "A", 2, True)
    (tmp_path / "sx.xml").write_text("<S><PtSituationElement><SituationNumber>7</SituationNumber><ValidityPeriod><StartTime>1970-01-01T01:00:00Z</StartTime></ValidityPeriod><Affects><Networks><AffectedNetwork><AffectedLine><LineRef>L</LineRef></AffectedLine></AffectedNetwork></Networks><StopPoints><AffectedStopPoint><StopPointRef>A</StopPointRef></AffectedStopPoint></StopPoints></Affects></PtSituationElement></S>")
    chosen, periods = messages.situations(spark.read.schema(messages.situations_schema()).option("rowTag", "PtSituationElement").format("xml").load(str(tmp_path / "sx.xml")))
    assert sorted((str(r.route_id), str(r.location_id)) for r in chosen.collect()) == [("L", "None"), ("None", "A")] and periods.first().begin == 60


def test_text_sinks(spark):
    legs = spark.createDataFrame([(0, 9, 1, 0, 5, 9, 77, 1505), (0, 9, 1, 1, 1, 5, 66, 490)], "query_id long, target long, transfers int, leg int, from_id long, to_id long, trip_id long, arr long")
    assert bundle.legs_as_text(legs).first().text == "1 -> 5 trip 66 arr 08:10\n5 -> 9 trip 77 arr 01:05+1"
