"""Parsers, catalogs, configuration, plugins, sinks, API and the registered queries."""

import sqlite3

import duckdb
import pytest

from rowloom import api, config, diff, plugins, textpool
from rowloom.errors import BadVirtualKey, ConfigInvalid, ConnectionFailed, MissingVariable, ParseFailed, PluginInvalid, UnknownGenerator, UnknownKey, redact
from rowloom.functions import names
from rowloom.operators.mapping import map_column
from rowloom.plans import registry
from rowloom.schema import Column, Kind, Schema, Table, excluded
from rowloom.sinks import sqltext
from rowloom.sources import catalog, drizzle, jpa, parse_any, prisma, typeorm

from .test_generate import SHOP

PRISMA = """
enum Role { ADMIN
 USER }
model User {
  id Int @id @default(autoincrement())
  email String @unique @db.VarChar(80) // mail
  role Role @default(USER)
  posts Post[]
  managerId Int? @map("manager_id")
  manager User? @relation("m", fields: [managerId], references: [id])
  reports User[] @relation("m")
  @@map("users")
}
model Post {
  id String @id @default(uuid())
  title String
  score Decimal? @db.Decimal(8, 3)
  authorId Int
  author User @relation(fields: [authorId], references: [id], onDelete: Cascade)
  tags Tag[]
  @@unique([authorId, title])
}
model Tag { id Int @id @default(autoincrement())
  name String
  posts Post[] }
"""
DRIZZLE = """
export const role = pgEnum('role', ['admin', 'user']);
export const users = pgTable('users', { id: serial('id').primaryKey(), email: varchar('email', { length: 80 }).notNull().unique(), kind: role('kind').default('user'), bornOn: date('born_on') });
export const posts = pgTable('posts', { id: uuid('id').primaryKey().defaultRandom(), authorId: integer('author_id').notNull().references(() => users.id, { onDelete: 'cascade' }), price: numeric('price', { precision: 8, scale: 2 }), slug: text() },
  (t) => [unique('u').on(t.authorId, t.slug)]);
"""
TYPEORM = """
export enum Role { ADMIN = 'admin', USER = 'user' }
@Entity('users') export class User { @PrimaryGeneratedColumn() id: number; @Column({ type: 'varchar', length: 80, unique: true }) email: string;
 @Column({ type: 'enum', enum: Role, default: Role.USER }) role: Role; @Column({ nullable: true }) age?: number; @CreateDateColumn() createdAt: Date; @OneToMany(() => Post, (p) => p.author) posts: Post[]; }
@Entity() export class Post { @PrimaryGeneratedColumn('uuid') id: string; @Column('text') body: string; @ManyToOne(() => User, (u) => u.posts, { onDelete: 'CASCADE' }) @JoinColumn({ name: 'author_id' }) author: User;
 @ManyToMany(() => Tag) @JoinTable({ name: 'post_tags' }) tags: Tag[]; }
@Entity() export class Tag { @PrimaryGeneratedColumn() id: number; @Column() name: string; }
"""
JPA = """
public enum Role { ADMIN, USER; }
@Entity @Table(name = "users", uniqueConstraints = @UniqueConstraint(columnNames = {"first_name", "email"})) public class User { @Id @GeneratedValue(strategy = GenerationType.IDENTITY) private Long id; @Column(nullable = false, unique = true, length = 80) private String email;
 @Enumerated(EnumType.STRING) private Role role; private String firstName; @Column(precision = 8, scale = 2) private BigDecimal balance; @OneToMany(mappedBy = "author") private List<Post> posts; @Transient private int tmp; }
@Entity public class Post { @Id @GeneratedValue private Long id; @Lob private String body; @ManyToOne(optional = false) @JoinColumn(name = "author_id") private User author; private LocalDateTime postedAt;
 @ManyToMany @JoinTable(name = "post_tags", joinColumns = @JoinColumn(name = "post_id"), inverseJoinColumns = @JoinColumn(name = "tag_id")) private Set<Tag> tags = new HashSet<>(); public String getBody() { return body; } }
@Entity public class Tag { @Id @GeneratedValue private Long id; private String name; }
"""


@pytest.mark.parametrize("parse,text,post", [(prisma.parse, PRISMA, "Post"), (drizzle.parse, DRIZZLE, "posts"), (typeorm.parse, TYPEORM, "post"), (jpa.parse, JPA, "post")])
def test_parsers_read_users_and_posts(spark, parse, text, post):
    s = parse(text)
    users, posts = s.tables["users"], s.tables[post]
    assert users.primary_key == ("id",) and users.column("id").auto_increment and ("email",) in users.uniques and users.column("email").max_length == 80
    enum = next(c for c in users.columns if c.kind is Kind.ENUM)
    assert len(enum.values) == 2
    author = posts.foreign_keys[0]
    assert author.table == "users" and author.references == ("id",) and not posts.column(author.columns[0]).nullable
    made = api.seed(spark, s, count=12)
    assert all(df.count() == 12 for df in made.tables.values())


def test_parser_details():
    s = prisma.parse(PRISMA)
    assert s.tables["_PostToTag"].uniques == (("A", "B"),) and ("authorId", "title") in s.tables["Post"].uniques and s.tables["Post"].column("score").scale == 3
    assert s.tables["users"].foreign_keys[0].columns == ("manager_id",) and s.tables["Post"].foreign_keys[0].on_delete == "CASCADE"
    assert ("author_id", "slug") in drizzle.parse(DRIZZLE).tables["posts"].uniques
    assert set(typeorm.parse(TYPEORM).tables) == {"users", "post", "tag", "post_tags"} and set(jpa.parse(JPA).tables) == {"users", "post", "tag", "post_tags"}
    assert ("first_name", "email") in jpa.parse(JPA).tables["users"].uniques
    for parse in (prisma.parse, drizzle.parse, typeorm.parse, jpa.parse):
        with pytest.raises(ParseFailed):
            parse("nothing here")


def test_catalogs(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE p(id INTEGER PRIMARY KEY, mail VARCHAR(20) UNIQUE, state TEXT CHECK(state IN ('on','off')), price DECIMAL(8,2) CHECK (price >= 0)); CREATE TABLE c(id INTEGER PRIMARY KEY, p_id INTEGER NOT NULL REFERENCES p);")
    s = parse_any(path)
    p = s.tables["p"]
    assert p.column("state").values == ("on", "off") and p.column("price").values == () and ("mail",) in p.uniques and p.column("id").auto_increment and s.tables["c"].foreign_keys[0].references == ("id",)
    out = api.seed(spark, s, count=9, url=f"sqlite:{tmp_path / 'out.db'}")
    assert out.summary.total == 18
    with sqlite3.connect(tmp_path / "out.db") as db:
        assert db.execute("SELECT count(*) FROM c WHERE p_id NOT IN (SELECT id FROM p)").fetchone()[0] == 0
    cols = spark.createDataFrame([("t", "id", 1, "integer", "NO", "nextval('s')"), ("t", "k", 2, "enum('a','b')", "YES", None)], "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string")
    t = catalog.schema_of_rows(cols, dialect="mysql").tables["t"]
    assert t.column("id").auto_increment and t.column("k").values == ("a", "b")
    assert [catalog.database_kind(u) for u in ("postgresql://h/d", "mysql://h", "a.sqlite", "x.parquet")] == ["postgres", "mysql", "sqlite", "files"]
    with pytest.raises(ConnectionFailed):
        catalog.guard("postgres://u:p@db.prod.example.com/x")
    assert catalog.literals("price > 1 AND x IN ('a')") == () and catalog.literals("s = ANY (ARRAY['a'::text,'b'])") == ("a", "b")
    assert redact("postgres://u:secret@h/d") == "postgres://u:***@h/d"


def test_names():
    assert names.normalise("User-Name_val", "users") == "name" and names.snake_case("HTTPServerID") == "http_server_id" and names.singular("categories") == "category"
    assert names.suggest("cuont", ["count", "seed"]) == "count" and names.suggest("zzzz", ["count"]) is None
    assert names.stem("payments") == names.stem("payment") and names.tokens("shipToCity") == ["ship", "to", "city"]
    assert excluded("public.audit_log", ["audit_*"]) and not excluded("public.audit", ["*.x"])


def test_config(spark, tmp_path):
    f = tmp_path / ".rowloom.yml"
    f.write_text("seed: 5\ncount: 7\nconnection: {url: '${DB}'}\ntables: {users: {count: 3, columns: {phone: {values: [a, b], weights: [9, 1], nullable: false}}, relationships: {}}}\nscenarios: {big: {tables: {users: 11}}}\n")
    c = config.load_file(f, {"DB": "sqlite:x"})
    assert c["connection"]["url"] == "sqlite:x" and config.find_file(str(tmp_path)) == f and config.scenario_counts(c, "big") == {"users": 11}
    g = config.generation_config(c)
    assert g.count("users") == 3 and g.count("orders") == 7
    made = api.run_pipeline(spark, SHOP, g, only=["users"]).tables["users"]
    assert {r["phone"] for r in made.collect()} <= {"a", "b"}
    with pytest.raises(MissingVariable):
        config.load_file(f, {})
    for bad, error in (({"cuont": 1}, UnknownKey), ({"count": -1}, ConfigInvalid), ({"tables": {"t": {"columns": {"c": {"generator": "person.frist_name"}}}}}, UnknownGenerator), ({"tables": {"t": {"relationships": {"c": "5..1"}}}}, ConfigInvalid), ({"existingData": "x"}, ConfigInvalid)):
        with pytest.raises(error):
            config.validate(bad)
    key = {"source": {"table": "users", "column": "phone"}, "target": {"table": "products", "column": "sku"}}
    assert config.inject_virtual_keys(SHOP, [key]).tables["users"].foreign_keys[0].virtual
    with pytest.raises(BadVirtualKey):
        config.inject_virtual_keys(SHOP, [{**key, "target": {"table": "x", "column": "y"}}])


def test_diff(tmp_path):
    a, b = Schema.of(SHOP.tables["users"], SHOP.tables["orders"]), Schema.of(SHOP.tables["users"], Table("orders", (Column("id"),)), Table("new", (Column("x"),)))
    diff.save_state(str(tmp_path / "s.json"), a)
    state = diff.load_state(str(tmp_path / "s.json"))
    assert diff.to_regenerate(state, b) == ["new", "orders"] and diff.diff(state, diff.hashes(b))["unchanged"] == ["users"]
    (tmp_path / "s.json").write_text("{")
    assert diff.load_state(str(tmp_path / "s.json")) is None


def test_plugins_and_pools(spark, tmp_path):
    from pyspark.sql import functions as F

    class Plate:
        name, suffixes, priority = "plate", ("_sku", "sku"), 5

        def build(self, ctx):
            return F.concat(F.lit("P-"), ctx.row.cast("string"))

    r = plugins.Registry()
    r.register(Plate())
    from rowloom.operators.generate import Config

    made = api.run_pipeline(spark, SHOP, Config(rows=5, builders=r.builder), only=["categories", "products"]).tables["products"]
    assert sorted(x["sku"] for x in made.collect()) == [f"P-{i}" for i in range(5)]
    with pytest.raises(PluginInvalid):
        r.register(object())
    assert textpool.parse_answer('x ["a", "b"]', 3) == ["a", "b", "a"] and textpool.parse_answer("1. one\n2. two", 2) == ["one", "two"]
    t = Table("t", (Column("review", Kind.TEXT),))
    pools, warnings = textpool.build_pools(Schema.of(t), lambda p, n: [f"text {i}" for i in range(n)], {"t": 4}, textpool.Cache(str(tmp_path)))
    assert pools["t", "review"] == ["text 0", "text 1", "text 2", "text 3"] and not warnings
    assert textpool.Cache(str(tmp_path)).get("t", "review", "4") and textpool.Cache(str(tmp_path), 0).get("t", "review", "4") is None


def test_text_pools_hold_a_text_for_each_row(spark, tmp_path):
    t = Table("t", (Column("id", Kind.INTEGER, auto_increment=True), Column("review", Kind.TEXT, nullable=False), Column("bio", Kind.TEXT, nullable=False), Column("enable_mail", Kind.BOOLEAN, nullable=False)), primary_key=("id",))
    asked = []

    def provider(prompt, n):
        asked.append(n)
        if "bio" in prompt and asked.count(50) > 3:
            raise OSError("no answer")
        return [f"text {len(asked)}-{i}" for i in range(n)]

    cache = textpool.Cache(str(tmp_path))
    lists, warnings = textpool.build_pools(Schema.of(t), provider, {"t": 130}, cache)
    assert asked == [50, 50, 30, 50, 50] and len(set(lists["t", "review"])) == 130
    assert len(lists["t", "bio"]) == 50 and len(warnings) == 1
    del asked[:]
    pools, warnings = textpool.pool_tables(spark, Schema.of(t), provider, {"t": 130}, cache, block=60)
    assert sorted(x["text"] for x in pools["t", "review"].collect()) == sorted(lists["t", "review"])
    assert asked == [50, 30] and pools["t", "bio"].count() == 130 and not warnings
    made = api.seed(spark, Schema.of(t), count=130, texts=provider, text_cache=cache).tables["t"].collect()
    assert {x["review"] for x in made} == set(lists["t", "review"]) and len(made) == 130
    assert map_column(t.column("enable_mail"), t).source == "prefix"

    def silent(prompt, n):
        raise OSError("no answer")

    got = api.seed(spark, Schema.of(t), count=5, texts=silent)
    assert got.tables["t"].where("review is not null").count() == 5 and len(got.warnings) == 2
    none = api.seed(spark, Schema.of(t), count=5, texts=lambda p, n: [])
    assert none.tables["t"].where("bio is not null").count() == 5


def test_sinks(spark, tmp_path):
    made = api.seed(spark, SHOP, count=20, path=str(tmp_path / "sql"), form="sql")
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "sql").rglob("*.txt")))
    con = duckdb.connect()
    con.sql('CREATE TABLE users(id INT, first_name TEXT, email TEXT, phone TEXT, is_verified BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP)')
    for line in text.splitlines():
        if line.startswith('INSERT INTO "users"'):
            con.sql(line)
    assert con.sql("SELECT count(*) FROM users").fetchall()[0][0] == 20 and text.count("COMMIT;") == 6 and "setval" in text
    assert made.summary.mode == "file" and made.summary.total == 120
    df = spark.createDataFrame([(1, True, None, ["a", None], 'x"y')], "a int, b boolean, c string, d array<string>, e string")
    assert df.select(sqltext.copy_lines(df, df.columns).alias("x")).first()["x"] == '1,t,\\N,"{""a"",NULL}","x""y"'
    assert sqltext.optimal_batch(10) == 2941 and sqltext.quoted('a.b"c') == '"a"."b""c"'
    quiet = api.seed(spark, SHOP, count=20, dry_run=True)
    assert quiet.summary.mode == "dry-run" and any("statements" in w for w in quiet.summary.warnings)


def test_seeder_and_chain(spark):
    with api.with_seed(spark, SHOP, seed=3) as s:
        made = s.table("users", 10).table("orders", 30).execute()
        assert made["orders"].join(made["users"], made["orders"]["user_id"] == made["users"]["id"], "left_anti").count() == 0
        again = s.seed("users", 5, overrides={"phone": {"values": ["z"]}})
        assert sorted(r["id"] for r in again.collect()) == [11, 12, 13, 14, 15]
        with pytest.raises(ConfigInvalid):
            s.seed("nope")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_equal_their_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) q").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
