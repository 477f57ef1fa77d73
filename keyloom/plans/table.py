"""The command table as data: arity, flags and key places of the 67 commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, arity (negative: at least), flags, first key, last key, key step.
COMMANDS = """
append 3 write,fast 1 1 1
auth -2 fast,noauth,loading 0 0 0
bgrewriteaof 1 admin 0 0 0
bgsave -1 admin 0 0 0
client -2 admin,loading 0 0 0
command -1 loading,noauth 0 0 0
config -2 admin,loading 0 0 0
copy -3 write 1 2 1
dbsize 1 readonly,fast 0 0 0
debug -2 admin 0 0 0
decr 2 write,fast 1 1 1
decrby 3 write,fast 1 1 1
del -2 write 1 -1 1
echo 2 fast 0 0 0
exists -2 readonly,fast 1 -1 1
expire -3 write,fast 1 1 1
expireat -3 write,fast 1 1 1
expiretime 2 readonly,fast 1 1 1
failover -1 admin 0 0 0
flushall -1 write 0 0 0
flushdb -1 write 0 0 0
get 2 readonly,fast 1 1 1
getdel 2 write,fast 1 1 1
getex -2 write,fast 1 1 1
getrange 4 readonly 1 1 1
getset 3 write,fast 1 1 1
hello -1 fast,noauth,loading 0 0 0
incr 2 write,fast 1 1 1
incrby 3 write,fast 1 1 1
incrbyfloat 3 write,fast 1 1 1
info -1 readonly,loading 0 0 0
keys 2 readonly 0 0 0
lastsave 1 readonly,fast 0 0 0
memory -2 readonly 0 0 0
mget -2 readonly,fast 1 -1 1
mset -3 write 1 -1 2
msetnx -3 write 1 -1 2
object -2 readonly 0 0 0
persist 2 write,fast 1 1 1
pexpire -3 write,fast 1 1 1
pexpireat -3 write,fast 1 1 1
pexpiretime 2 readonly,fast 1 1 1
ping -1 fast,loading 0 0 0
psetex 4 write 1 1 1
pttl 2 readonly,fast 1 1 1
quit -1 fast,noauth,loading 0 0 0
randomkey 1 readonly 0 0 0
rename 3 write 1 2 1
renamenx 3 write,fast 1 2 1
reset 1 fast,noauth,loading 0 0 0
save 1 admin 0 0 0
scan -2 readonly 0 0 0
select 2 fast,loading 0 0 0
set -3 write 1 1 1
setex 4 write 1 1 1
setnx 3 write,fast 1 1 1
setrange 4 write 1 1 1
shutdown -1 admin,noauth,loading 0 0 0
strlen 2 readonly,fast 1 1 1
substr 4 readonly 1 1 1
swapdb 3 write,fast 0 0 0
time 1 fast,loading 0 0 0
touch -2 readonly,fast 1 -1 1
ttl 2 readonly,fast 1 1 1
type 2 readonly,fast 1 1 1
unlink -2 write,fast 1 -1 1
wait 3 fast 0 0 0
"""

#: What COMMAND DOCS says: name, first version, summary.
DOCS = """
append 2.0.0 Append a value to a key
auth 1.0.0 Authenticate
bgrewriteaof 1.0.0 Compact the write-ahead log
bgsave 1.0.0 Write a snapshot in the background
client 2.4.0 Inspect and control connections
command 2.8.13 Describe the command table
config 2.0.0 Read and change configuration
copy 6.2.0 Copy a key
dbsize 1.0.0 Return the number of keys
debug 1.0.0 Internal diagnostics
decr 1.0.0 Decrement the integer value of a key by one
decrby 1.0.0 Decrement the integer value of a key
del 1.0.0 Delete one or more keys
echo 1.0.0 Echo the given string
exists 1.0.0 Count how many of the given keys exist
expire 1.0.0 Set a key's time to live in seconds
expireat 1.2.0 Set the expiration of a key as a Unix timestamp in seconds
expiretime 7.0.0 Return the absolute expiry of a key in seconds
failover 6.2.0 Trigger a failover
flushall 1.0.0 Remove every key
flushdb 1.0.0 Remove every key
get 1.0.0 Return the string value of a key
getdel 6.2.0 Return the value of a key and delete it
getex 6.2.0 Return the value of a key and change its expiration
getrange 2.4.0 Return a substring of the value at a key
getset 1.0.0 Set a key and return its old value
hello 6.0.0 Handshake and optionally switch protocol version
incr 1.0.0 Increment the integer value of a key by one
incrby 1.0.0 Increment the integer value of a key
incrbyfloat 2.6.0 Increment the float value of a key
info 1.0.0 Report server statistics
keys 1.0.0 Return all keys matching a pattern
lastsave 1.0.0 Report the last snapshot time
memory 4.0.0 Report memory usage
mget 1.0.0 Return the values of several keys
mset 1.0.1 Set several keys
msetnx 1.0.1 Set several keys only when none of them exist
object 2.2.3 Inspect a key's representation
persist 2.2.0 Remove a key's expiration
pexpire 2.6.0 Set a key's time to live in milliseconds
pexpireat 2.6.0 Set the expiration of a key as a Unix timestamp in milliseconds
pexpiretime 7.0.0 Return the absolute expiry of a key in milliseconds
ping 1.0.0 Ping the server
psetex 2.6.0 Set the value and expiration of a key in milliseconds
pttl 2.6.0 Return a key's remaining time to live in milliseconds
quit 1.0.0 Close the connection
randomkey 1.0.0 Return a random key
rename 1.0.0 Rename a key
renamenx 1.0.0 Rename a key only when the destination does not exist
reset 6.2.0 Reset the connection to its initial state
save 1.0.0 Write a snapshot synchronously
scan 2.8.0 Incrementally iterate the keyspace
select 1.0.0 Select a database
set 1.0.0 Set the string value of a key
setex 2.0.0 Set the value and expiration of a key in seconds
setnx 1.0.0 Set the value of a key only when it does not exist
setrange 2.2.0 Overwrite part of the value at a key
shutdown 1.0.0 Stop the server
strlen 2.2.0 Return the length of the value stored at a key
substr 1.0.0 Deprecated alias for GETRANGE
swapdb 4.0.0 Swap two databases
time 2.6.0 Report server time
touch 3.2.1 Count how many of the given keys exist, updating their access time
ttl 1.0.0 Return a key's remaining time to live in seconds
type 1.0.0 Return the type of the value stored at a key
unlink 4.0.0 Delete one or more keys, reclaiming memory lazily
wait 3.0.0 Wait for replication acknowledgements
"""


def docs() -> dict[str, tuple[str, str]]:
    """Version and summary by name."""
    rows = (line.split(" ", 2) for line in DOCS.split("\n") if line)
    return {name: (since, summary) for name, since, summary in rows}


def table() -> dict[str, tuple[int, tuple[str, ...], int, int, int]]:
    out = {}
    for line in COMMANDS.split("\n"):
        if line:
            name, arity, flags, first, last, step = line.split()
            out[name] = (int(arity), tuple(flags.split(",")), int(first), int(last), int(step))
    return out


def command_table(spark: SparkSession) -> DataFrame:
    rows = [(k, a, list(f), x, y, z) for k, (a, f, x, y, z) in table().items()]
    return spark.createDataFrame(rows, "name string, arity int, flags array<string>, first_key int, last_key int, key_step int")


def fits(arity: int, n: int) -> bool:
    return n == arity if arity > 0 else n >= -arity


def key_places(name: str, n: int) -> list[int]:
    """Places of the keys among ``n`` arguments, the name included."""
    _, _, first, last, step = table()[name]
    if not first:
        return []
    return list(range(first, (n + last if last < 0 else last) + 1, step))
