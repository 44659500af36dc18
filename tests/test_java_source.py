"""Java read by tokens: from sources to edges, handlers, clients and topics."""

from weftline.sources import java_source as j

OWNER = '''package a.b;
/* class Fake { @Entity } */
@Entity @Table(name = "owners", schema = "s")
public class Owner extends Base<Long> implements Serializable {
  @Column(name = "last_name") private String lastName = "a; {";
  private final Map<String, List<Pet>> pets = new HashMap<>() {{ put("x", null); }};
  @Override public String toString() { return "class X { repo.findAll() }"; } // repo.save(x)
  enum Kind { A("x") { int f() { return 1; } }, B; int n; void g() { go(1); } }
}
'''
REPOSITORY = '''package a.b;
public interface OwnerRepository extends JpaRepository<Owner, Integer>, Other {
  List<Owner> findByLastName(String lastName);
  @Query("select o from Owner o " + "where o.city = ?1") List<Owner> inCity(@Param("c") String c);
  @Query(value = "UPDATE owners SET city = 'x'", nativeQuery = true) void move();
  default List<Owner> named(String n) { return this.findByLastName(n); }
}
'''
SERVICE = '''package a.b;
@RestController @RequestMapping("/api/")
class OwnerController {
  private final OwnerRepository owners;
  OwnerController(OwnerRepository owners) { this.owners = owners; }
  @GetMapping("/owners/{id}") Owner one(@PathVariable int id) { return this.owners.findById(id).orElse(null); }
  @PostMapping(path = "/owners") void add(Owner o) { owners.save(o); owners.flush(); helper.x().findAll(); }
  @KafkaListener(topics = "moves") void heard(String s) { owners.move(); owners.named(s); owners.inCity("a"); owners.findAll(1, 2); }
}
@FeignClient(name = "visits") interface Visits { @GetMapping("/visits") List<Visit> all(@RequestParam int a, int b); }
'''
TOPOLOGY = '''import org.apache.kafka.streams.StreamsBuilder;
class T { void build(StreamsBuilder b) { b.stream("in").mapValues(v -> v).to("out"); b.table(name()); b.stream(); } }
'''
FILES = [("Owner.java", OWNER), ("OwnerRepository.java", REPOSITORY), ("Service.java", SERVICE), ("T.java", TOPOLOGY), ("U.java", TOPOLOGY.split("\n", 1)[1]), ("bad.java", "class { ((("), ("none.java", None)]


def read(spark):
    return j.facts(spark.createDataFrame(FILES, "path string, content string"))


def test_facts():
    got = j.read_java("Owner.java", OWNER)
    assert [(k, o, n) for _, k, o, n, _, _ in got if k != "call"] == [
        ("package", "", "a.b"), ("type", "", "Owner"), ("field", "Owner", "lastName"), ("field", "Owner", "pets"), ("method", "Owner", "toString"), ("type", "Owner", "Owner.Kind"), ("field", "Owner.Kind", "n"), ("method", "Owner.Kind", "g"),
    ]
    assert [(n, line) for _, k, _, n, line, _ in got if k == "call"] == [("go", 8)]
    assert dict(got[1][5])["table"] == "owners" and dict(got[2][5]) == {"type": "String", "column": "last_name", "annotations": "Column"}
    assert j.read_java("x", "class A { int a") and j.read_java("x", "}}} ) @") == []


def test_edges_of_a_code_base(spark):
    got = {(r["caller"], r["method"], r["table"], r["edge_type"], r["code"]) for r in j.spring_edges(read(spark)).collect()}
    heard = "OwnerController#heard"
    assert got == {
        ("OwnerController#one", "findById", "owners", "READS", None), ("OwnerController#add", "save", "owners", "WRITES", None), ("OwnerController#add", "flush", None, None, "ignored-repository-operation"),
        (heard, "move", "owners", "WRITES", None), (heard, "named", "owners", "READS", None), (heard, "inCity", "owners", "READS", None), (heard, "findAll", None, None, "unsupported-operation"),
    }


def test_handlers_clients_and_topics(spark):
    f = read(spark)
    assert {(r["channel"], r["operation"], r["handler"], r["line"]) for r in j.inbound(f).collect()} == {("REST", "GET /api/owners/{id}", "OwnerController#one", 6), ("REST", "POST /api/owners", "OwnerController#add", 7), ("ASYNC_EVENT", "moves", "OwnerController#heard", 8)}
    assert [(r["to_service"], r["operation"], r["handler"]) for r in j.outbound(f).collect()] == [("visits", "GET /visits", "Visits#all")]
    assert {(r["path"], r["called"], r["topic"], r["edge_type"], r["code"], r["method"]) for r in j.stream_topology(f).collect()} == {("T.java", "stream", "in", "READS", None, "build"), ("T.java", "to", "out", "WRITES", None, "build"), ("T.java", "table", None, None, "dynamic-destination", "build")}


def test_made_files_are_spread_and_read_once(spark, small):
    from weftline.plans import source_queries as q

    for df in (q._files(spark, small, ".yml", "x: @"), q._migrations(spark, small), q._builds(spark, small), q._schemas(spark, small)):
        assert df.rdd.getNumPartitions() >= 4  # the table itself is one task
    for made in (q.s9_spring_edges, q.s11_inbound, q.s12a_stream_topology):
        assert "MapInArrow" not in made(spark, small)._jdf.queryExecution().executedPlan().toString()
